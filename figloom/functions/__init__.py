"""figloom.functions"""
