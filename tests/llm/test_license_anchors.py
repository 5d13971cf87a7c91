"""No match of a license template is missed, whichever words are changed."""

import pytest

from sharecast.llm import license_scan

from .test_native_operators import documents


@pytest.mark.parametrize("elsewhere", [False, True])
def test_matches_with_the_rarest_words_changed(spark, elsewhere):
    rows, want = [], {}
    notices = license_scan._index_rows(phrases=[])
    for i, (_, label, w, need, a, b) in enumerate(notices):
        free = [j for j in range(len(w)) if not a <= j < b]
        for k in range(len(free)):
            changed = {free[(k + s) % len(free)] for s in range(len(w) - need)}
            rows.append((100 * i + k, "so " * k + " ".join("other" if j in changed else x for j, x in enumerate(w)) + " end"))
            want[100 * i + k] = (label, k, len(w) - len(changed))
        gone = [x for j, x in enumerate(w) if j != a]                          # the key phrase broken: no match
        rows.append((100 * i + 99, " ".join(gone)))
    if elsewhere:       # the words of the notices are all in the corpus, or only those in place
        rows += [(10_000 + i, " ".join(r[2])) for i, r in enumerate(notices)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, rows), phrases=[]).collect()}
    for d, (label, start, same) in want.items():
        assert (label, start, same) in [(m.label, m.start, m.in_place) for m in got[d].matches], d
    assert all(not got[100 * i + 99].matches for i in range(len(notices)))
