"""cutloom.operators"""
