"""sparklode.functions"""
