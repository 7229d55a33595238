"""darkslide.streaming"""
