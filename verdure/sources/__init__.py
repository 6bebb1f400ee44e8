"""verdure.sources"""
