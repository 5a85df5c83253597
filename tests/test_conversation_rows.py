"""history_view and missing_is_concrete keep the rows that their SQL leaves out."""

import re

from quern.catalogue import QUERIES
from quern.functions.text import VAGUE

SAID = ["", "plain", "an answer\n**Sources**: [1] here", "  \n", "long " * 400, "one\n## sources\n[2] there\nmore", None]
ASKED = ["more info", "anything", "n/a", "context of course 7", "tab\there. rest", "two\nlines", "The Details", "none", "detail 5", "a1", "", None]


def view(text):
    if text is None:
        return None
    answer = text + "\n**Sources**: [1] x"
    kept = re.sub(r"\n[ \t*#]*Sources[ \t*#]*:?.*\Z", "", answer, flags=re.I | re.S, count=1)
    kept = kept.rstrip()
    return answer[:1500] if not kept else kept[:1500].rstrip() + " ..." if len(kept) > 1500 else kept


def concrete(item):
    return len(item) >= 3 and item not in VAGUE and bool(re.search("[0-9]", item) or len(re.split(r"[ \t\n\x0b\f\r]+", item)) >= 2)


def test_all_rows_are_kept(spark, tmp_path):
    rows = [(1, i, "assistant", t) for i, t in enumerate(SAID)] + [(2, i, "user", t) for i, t in enumerate(ASKED)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: r["view"] for r in QUERIES["history_view"](spark, str(tmp_path)).collect()}
    assert got == {i: view(t) for i, t in enumerate(SAID)}
    rows = QUERIES["missing_is_concrete"](spark, str(tmp_path)).collect()
    assert {r["turn"]: r["x"] for r in rows if r["i"] == 0} == {i: None if t is None else t.split(".")[0] for i, t in enumerate(ASKED)}
    assert len(rows) == 4 * len(ASKED) and all(r["concrete"] == concrete((r["x"] or "").strip().lower()) for r in rows)
