"""figloom.operators"""
