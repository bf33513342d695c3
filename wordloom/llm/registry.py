"""The corpus operators' queries and their SQL, by name."""

from importlib import import_module

_MODULES = ("lines", "warc", "sharding", "urls", "quality", "mixing", "decontaminate", "passages", "tokens", "simhash")
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in _MODULES:
    _module = import_module(f".{_name}", __package__)
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
