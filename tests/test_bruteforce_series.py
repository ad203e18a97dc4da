"""Brute force on a small fixture: every subject's hourly sequence, computed
slot by slot from the definition, equals the Spark result."""

import math
from collections import defaultdict
from statistics import mean, stdev

from wardlens.plans import q_features, q_series
from wardlens.sources.tables import Tables

SF = "/root/testdata/sf0.01"
N = 48


def nearest_even(x):
    low = math.floor(x)
    return low + (x - low > 0.5 or (x - low == 0.5 and low % 2 == 1))


def sequences(cells):
    """{(subject, hour, word)}: for each of a subject's last N hours, the words of the first observed hour at
    or after it."""
    last = defaultdict(int)
    for subject, hour, _, _ in cells:
        last[subject] = max(last[subject], hour)
    window = [c for c in cells if last[c[0]] >= N and c[1] >= last[c[0]] - N]
    by_label, by_subject = defaultdict(list), defaultdict(list)
    for subject, _, label, value in window:
        by_label[label].append(value)
        by_subject[label, subject].append(value)
    centre = {label: mean(mean(v) for (name, _), v in by_subject.items() if name == label) for label in by_label}
    spread = {label: stdev(v) for label, v in by_label.items() if len(v) > 1}
    words = defaultdict(lambda: defaultdict(set))
    for subject, hour, label, value in window:
        if spread.get(label):
            z = max(-4, min(4, nearest_even((value - centre[label]) / spread[label])))
            words[subject][hour].add(f"{label}_{z}")
    out = set()
    for subject, hours in words.items():
        for slot in range(last[subject] - N + 1, last[subject] + 1):
            source = min(h for h in hours if h >= slot)
            out |= {(subject, slot, w) for w in hours[source]}
    return out


def test_sequences_equal_the_definition(spark):
    t = Tables(spark, SF)
    cells = [tuple(r) for r in q_series.fixture_cells(t).select("subject_id", "hours_in", "label", "valuenum_avg").collect()]
    want = sequences([c for c in cells if c[3] is not None])
    got = {(r["subject_id"], r["hours_in"], r["feature"]) for r in q_features.fixture_seq_words(t).collect()}
    assert len(want) > 1000 and got == want
