"""meshwalk.streaming"""
