"""darkslide.functions"""
