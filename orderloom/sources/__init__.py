"""orderloom.sources"""
