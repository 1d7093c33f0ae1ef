"""Sizes of expressions."""


def expression_size(df) -> int:
    """Nodes of the expressions of the last projection."""
    def size(expression) -> int:
        kids = expression.children()
        return 1 + sum(size(kids.apply(k)) for k in range(kids.size()))

    found = df._jdf.queryExecution().analyzed().expressions()
    return sum(size(found.apply(k)) for k in range(found.size()))
