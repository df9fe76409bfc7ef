"""sparklode.sources"""
