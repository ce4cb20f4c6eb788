"""figloom.sources"""
