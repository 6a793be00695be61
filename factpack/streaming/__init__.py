"""factpack.streaming"""
