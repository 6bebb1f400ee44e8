"""verdure.operators"""
