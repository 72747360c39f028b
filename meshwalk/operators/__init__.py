"""meshwalk.operators"""
