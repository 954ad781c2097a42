"""twinsieve.plans"""
