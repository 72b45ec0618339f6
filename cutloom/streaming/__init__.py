"""cutloom.streaming"""
