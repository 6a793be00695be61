"""factpack.functions"""
