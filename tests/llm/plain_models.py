"""Plain versions of what operators do, for the tests."""

from fractions import Fraction


def targets(sizes, weights, cap=3):
    """Words for each source, shared again and again in exact fractions."""
    out, rest, total = [Fraction(0)] * len(sizes), list(range(len(sizes))), Fraction(sum(sizes))
    while rest:
        share = total / sum(weights[i] for i in rest)
        over = [i for i in rest if share * weights[i] > cap * sizes[i]]
        for i in over or rest:
            out[i] = Fraction(cap * sizes[i]) if over else share * weights[i]
        if not over:
            break
        total -= sum(out[i] for i in over)
        rest = [i for i in rest if i not in set(over)]
    return [float(x) for x in out]
