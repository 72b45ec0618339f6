"""cutloom.sources"""
