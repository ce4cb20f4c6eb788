"""figloom.plans"""
