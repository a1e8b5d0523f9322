"""orderloom.streaming"""
