"""loomline.operators"""
