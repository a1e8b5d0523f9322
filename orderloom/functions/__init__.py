"""orderloom.functions"""
