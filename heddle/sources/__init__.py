"""heddle.sources"""
