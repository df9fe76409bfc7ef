"""sparklode.operators"""
