"""cutloom.functions"""
