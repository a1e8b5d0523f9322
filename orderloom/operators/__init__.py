"""orderloom.operators"""
