"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it; the queries it contributes are listed in ``credsift.llm.queries``.
"""
