"""foliant.operators"""
