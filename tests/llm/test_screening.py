import numpy as np

from lacuna.llm import toxicity


def screened(signals, n_null=5000):
    """Words of one row each: signals in 6 of 40 toxic and 5 of 260 clean texts (4.1 deviations), the others in 0.05 of both."""
    docs = [[] for _ in range(300)]
    for w in range(signals):
        for i in [*((w + k) % 40 for k in range(6)), *(40 + (w + k) % 260 for k in range(5))]:
            docs[i].append(w)
    for w in range(signals, signals + n_null):
        for i in [*((w + k) % 40 for k in range(2)), *(40 + (w + k) % 260 for k in range(13))]:
            docs[i].append(w)
    n = signals + n_null
    y = np.array([1] * 40 + [0] * 260)
    return toxicity._screened(np.arange(n), np.arange(n + 1), [np.array(d, np.int32) for d in docs], y, n)


def test_many_weak_differences_are_learnt():
    known = screened(20)
    assert known[:20].all() and not known[20:].any()


def test_what_chance_may_hold_is_not_learnt():
    assert not screened(1).any() and not screened(0).any() and not screened(0, 0).any()
