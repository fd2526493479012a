"""Averaged perceptron over string features."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable, Sequence


class AveragedPerceptron:
    """Chooses one of several options, each with its own features; weights are averaged over all steps."""

    def __init__(self) -> None:
        self.weights: dict[Hashable, float] = {}

    def score(self, features: Iterable[Hashable]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def best(self, options: Sequence[Sequence[Hashable]]) -> int:
        """Index of the best option; the first of equal ones."""
        scores = [self.score(o) for o in options]
        return scores.index(max(scores))

    def train(self, examples: Sequence, rounds: int = 5, features: Callable = lambda x: x) -> AveragedPerceptron:
        """``examples``: what ``features`` makes options' features from, and the right option.

        Features are made when they are needed, so that the examples stay small. Their order is fixed, so training is repeatable.
        """
        w: dict[Hashable, float] = defaultdict(float)
        total: dict[Hashable, float] = defaultdict(float)
        since: dict[Hashable, int] = defaultdict(int)
        step = 0
        self.weights = w
        for r in range(rounds):
            # A fixed stride gives each round another order.
            stride = next(s for s in (7919, 104729, 1299709) if len(examples) % s) if examples else 1
            for i in range(len(examples)):
                made, right = examples[(i * stride + r) % len(examples)]
                options = features(made)
                step += 1
                got = self.best(options)
                if got != right:
                    for f, d in [(f, 1.0) for f in options[right]] + [(f, -1.0) for f in options[got]]:
                        total[f] += (step - since[f]) * w[f]
                        since[f] = step
                        w[f] += d
        for f in w:
            total[f] += (step - since[f]) * w[f]
        self.weights = {f: t / max(1, step) for f, t in total.items() if t}
        return self
