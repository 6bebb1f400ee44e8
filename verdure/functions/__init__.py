"""verdure.functions"""
