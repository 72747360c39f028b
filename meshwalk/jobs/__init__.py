"""meshwalk.jobs"""
