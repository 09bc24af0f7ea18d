"""loomline.sources"""
