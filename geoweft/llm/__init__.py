"""Training-data operators (see the README's section on them).

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` list
what the entry module registers when the subpackage is there.
"""
