from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from stratakit.operators import markdown as M

PROSE = "Words that say something about a thing. " * 12
TEXT = f"""# Title

{PROSE}

Short one.

<!-- page 2 -->

## Data

| a | b |
|---|---|
| 1 | 2 |

$$ x = y^2 $$ (3)

Figure 4: a caption
over two lines

```
{"code line " * 30}
# no heading
```

{"long " * 700}

# References

[1] Smith, J. (2001). A title.

[2] Other, K. (2002). Another.
"""


def test_kinds_headings_and_pages():
    got = [(k, h, p, TEXT[a:b]) for k, h, p, a, b in M.passages_of(TEXT)]
    assert [(k, h) for k, h, _, _ in got[:5]] == [("text", "Title"), ("table", "Title / Data"), ("formula", "Title / Data"), ("figure", "Title / Data"), ("code", "Title / Data")]
    assert got[0][3].endswith("Short one.") and got[0][2] is None and all(p == 2 for _, _, p, _ in got[1:])
    assert [t for k, _, _, t in got if k == "reference"] == ["[1] Smith, J. (2001). A title.", "[2] Other, K. (2002). Another."]
    windows = [t for k, _, _, t in got if k == "text" and "long" in t]
    assert len(windows) > 3 and all(len(t) <= M.WINDOW for t in windows)
    assert not any("no heading" in h for _, h, _, _ in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# H", "## K", "text here", "", "| a |", "|---|", "```", "$$x$$", "Figure 1 x", "<!-- page 3 -->", "w " * 500, "- item", "   "]), max_size=25).map("\n".join))
def test_nothing_is_lost(text):
    """Every letter outside headings and page marks lies in a passage; passages go forward and none is empty."""
    got = list(M.passages_of(text))
    held = set().union(*[range(a, b) for *_, a, b in got])
    skipped = set().union(*[range(a, b) for k, a, b in M.elements(text) if k in ("heading", "page")])
    assert all(c.isspace() or i in held or i in skipped for i, c in enumerate(text))
    assert all(a < b for *_, a, b in got) and [a for *_, a, _ in got] == sorted(a for *_, a, _ in got)
    assert all(b - a <= M.MOST for k, *_, a, b in got if k == "text")


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\nb"), (None, "c")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.text) for r in M.passages(docs).collect()) == [("3", "a\n\nb"), ("None", "c")]
