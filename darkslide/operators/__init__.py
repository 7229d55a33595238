"""darkslide.operators"""
