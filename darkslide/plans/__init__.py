"""darkslide.plans"""
