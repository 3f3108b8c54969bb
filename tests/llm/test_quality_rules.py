from __future__ import annotations

import re

from offerscope.llm.quality_rules import BASE, POLICIES, ablations, apply_policy, ledger


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    seen, at = {}, [False] * len(w)
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                at[p : p + 8] = [True] * 8
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(at), len(w) < 20 or 100 * sum(at) > 30 * len(w)


def test_measures_equal_brute_force(edge, edge_rows, empty):
    text = {r[0]: r[1] for r in edge_rows if r[0] is not None}
    rows = apply_policy(ledger(edge)).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert apply_policy(ledger(empty)).count() == 0


def test_policies_and_ablations_read_the_ledger(edge):
    rows = ledger(edge).cache()
    bits = [r.failed_bits for r in rows.collect()]
    for version, mask in POLICIES.items():
        assert apply_policy(rows, version).filter("kept").count() == sum(not b & (mask | BASE) for b in bits)
    for r in ablations(rows, 3).collect():
        from offerscope.llm.quality_rules import RULES

        bit = 1 << RULES[r.rule]
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_only == sum(b & POLICIES[3] == bit for b in bits)
        assert r.n_kept_without == sum(not b & POLICIES[3] & ~bit for b in bits)
