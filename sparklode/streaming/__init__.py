"""sparklode.streaming"""
