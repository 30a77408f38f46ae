import pytest

from quotelake.operators import router

PASSAGES = [
    (e, w, s, i, f"{e} {w} {s}:{i}")
    for e in ("NKJV", "AMP", "ESV") for w, s, i in [
        ("Ezekiel", 36, 26), ("Ezekiel", 36, 27), ("Ezekiel", 36, 28), ("Ezekiel", 37, 1), ("Romans", 8, 28),
        ("2 Kings", 6, 2), ("3 John", 1, 4), ("Jude", 1, 24), ("Jude", 1, 25), ("Song of Solomon", 1, 1),
    ] if not (e == "ESV" and w == "Jude")
]
EZ, JU = ("NKJV", "Ezekiel", 36, 27), ("NKJV", "Jude", 1, 25)
NONE = (None, None, None, None)
CASES = [
    ("turn to Romans 8:28", NONE, "EXPLICIT_REF", None, "NKJV Romans 8:28"),
    ("second kings 6 2", NONE, "EXPLICIT_REF", None, "NKJV 2 Kings 6:2"),
    ("III John 1 4", NONE, "EXPLICIT_REF", None, "NKJV 3 John 1:4"),
    ("song of solomon 1:1", NONE, "EXPLICIT_REF", None, "NKJV Song of Solomon 1:1"),
    ("Ezekiel chapter 36 verse 27", NONE, "EXPLICIT_REF", None, "NKJV Ezekiel 36:27"),
    ("about 20 30 people", NONE, "EXPLICIT_REF", None, None),
    ("next verse", NONE, "NAV_COMMAND", "next_verse", None),
    ("next verse", EZ, "NAV_COMMAND", "next_verse", "NKJV Ezekiel 36:28"),
    ("go back one verse", EZ, "NAV_COMMAND", "prev_verse", "NKJV Ezekiel 36:26"),
    ("next chapter", EZ, "NAV_COMMAND", "next_chapter", "NKJV Ezekiel 37:1"),
    ("give me that in the Amplified", EZ, "NAV_COMMAND", "swap_translation", "AMP Ezekiel 36:27"),
    ("now in the ESV", EZ, "NAV_COMMAND", "swap_translation", "ESV Ezekiel 36:27"),
    ("read it in the message", EZ, "NAV_COMMAND", "swap_translation", None),
    ("next verse", JU, "NAV_COMMAND", "next_verse", None),
    ("previous verse", JU, "NAV_COMMAND", "prev_verse", "NKJV Jude 1:24"),
    ("take it down", EZ, "CLEAR_COMMAND", None, None),
    ("not that one", EZ, "CLEAR_COMMAND", None, None),
    ("the Bible says", EZ, "CUE_PHRASE", None, None),
    ("I went to the shop", EZ, "CUE_PHRASE", None, None),
]


@pytest.fixture(scope="module")
def routed(spark):
    rows = [(i, text, *anchor) for i, (text, anchor, *_) in enumerate(CASES)]
    utts = spark.createDataFrame(
        rows, "utt_id int, text string, a_edition string, a_work string, a_section int, a_item int"
    )
    passages = spark.createDataFrame(PASSAGES, "edition string, work string, section int, item int, text string")
    return {r["utt_id"]: r for r in router.route(utts, passages).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(routed, i):
    _, _, intent, action, text = CASES[i]
    row = routed[i]
    assert (row["intent"], row["action"], row["passage_text"]) == (intent, action, text)
    if intent in ("EXPLICIT_REF", "NAV_COMMAND"):
        assert (row["reason"] is None) == (text is not None)
