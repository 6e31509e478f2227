"""Expressions over class-probability arrays, as SQL text for ``F.expr``.

Arguments are column names or other expressions. The number of classes is known when a plan is
built, so arrays are unrolled into scalar expressions, which stay inside code generation, while
they are short. A generated method over 8000 bytes is never compiled by the JVM; longer work is
split over several projections or folded over the array.
"""

from __future__ import annotations

from gradeloom.functions.text import array, clipped, largest, number, pick, slots, total

EPS = 1e-12  # lower clip inside entropies
FLOAT64_EPS = 2.220446049250313e-16  # clip of the log loss


def softmax(logits: str, n: int, temperature: str = "") -> str:
    """Softmax of ``logits / temperature``, shifted by the largest logit."""
    z = [f"{v} / {temperature}" for v in slots(logits, n)] if temperature else slots(logits, n)
    top = largest(z)
    e = [f"exp({v} - {top})" for v in z]
    norm = total(e)
    return array(f"{v} / {norm}" for v in e)


def log_sum_exp(logits: str, n: int) -> str:
    """``ln`` of the sum of exponentials; a logit minus this is its log probability."""
    z = slots(logits, n)
    top = largest(z)
    return f"({top} + ln({total(f'exp({v} - {top})' for v in z)}))"


def argmax(vector: str) -> str:
    """Index of the largest element, the first one on ties."""
    return f"cast(array_position({vector}, array_max({vector})) - 1 AS int)"


def argmax_of(parts: list[str]) -> str:
    """As :func:`argmax`, over scalar expressions."""
    top = largest(parts)
    return "CASE " + " ".join(f"WHEN {p} = {top} THEN {k}" for k, p in enumerate(parts)) + " END"


def one_hot(y: str, n: int) -> str:
    return array(f"cast({y} = {k} AS double)" for k in range(n))


def at_class(vector: str, y: str, n: int) -> str:
    """Element of the true class."""
    return pick(y, slots(vector, n))


def top_two(vector: str, n: int) -> tuple[str, str]:
    """Largest and second largest element; the second is 0 with a single class."""
    ordered = f"sort_array({vector}, false)"
    return f"{ordered}[0]", f"{ordered}[1]" if n > 1 else "0.0D"


def margin(vector: str, n: int) -> str:
    first, second = top_two(vector, n)
    return f"({first} - {second})"


def entropy(vector: str, eps: float = EPS) -> str:
    """Entropy with probabilities clipped to ``eps`` and 1.

    A fold over the array: a meta-feature row holds one entropy per model, and unrolled they would
    make the generated method too long for the JVM to compile.
    """
    p = f"({clipped('p', eps, 1.0)})"
    return f"aggregate({vector}, 0.0D, (s, p) -> s - {p} * ln({p}))"


def uniform(n: int) -> str:
    return array([number(1.0 / n)] * n)


def normalised(vector: str, n: int) -> str:
    """Divide by the sum; uniform where the sum is 0."""
    s = total(slots(vector, n))
    shares = array(f"{p} / {s}" for p in slots(vector, n))
    return f"CASE WHEN {s} > 0 THEN {shares} ELSE {uniform(n)} END"


def log_loss_term(probs: str, y: str, n: int, eps: float = FLOAT64_EPS) -> str:
    """``-ln`` of the true class's probability, clipped and normalised over the row."""
    share = f"({at_class(probs, y, n)} / {total(slots(probs, n))})"
    return f"(-ln({clipped(share, eps, 1.0 - eps)}))"


def checked_width(vector: str, n: int) -> str:
    """``vector``; a row whose array does not have ``n`` elements is an error."""
    fault = f"raise_error(concat('expected {n} classes but got ', size({vector})))"
    return f"CASE WHEN size({vector}) = {n} THEN {vector} ELSE {fault} END"
