"""factpack.plans"""
