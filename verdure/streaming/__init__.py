"""verdure.streaming"""
