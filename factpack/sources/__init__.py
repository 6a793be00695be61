"""factpack.sources"""
