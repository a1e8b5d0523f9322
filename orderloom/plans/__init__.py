"""orderloom.plans"""
