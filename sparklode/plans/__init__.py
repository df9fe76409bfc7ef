"""sparklode.plans"""
