"""meshwalk.functions"""
