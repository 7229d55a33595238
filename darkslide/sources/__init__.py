"""darkslide.sources"""
