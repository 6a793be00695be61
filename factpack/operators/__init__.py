"""factpack.operators"""
