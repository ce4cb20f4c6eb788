"""figloom.streaming"""
