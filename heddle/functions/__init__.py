"""heddle.functions"""
