"""meshwalk.sources"""
