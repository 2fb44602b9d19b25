"""Golden inputs: text events and the drafts they must give."""

MEADOW = """Freddy new draft. Notes on the meadow behind the mill:
    the grass stands high in June, and the path is hard to find unless one keeps to the ditch on the left side of the old wall.

After the second gate there are four ash trees, of which the last one has lost its crown; from there the brook can be heard, and in
a wet year also seen. Nobody has mown here since the mill was sold. We should walk it again in autumn. Freddy break break.

Freddy Take this down.

On the way back we counted swallows, as every year, and came to a number that nobody believed; the notebook with the count
was left on the bridge. Freddy break break
    """

# name -> (rows of (text, start, end), drafts of (stripped text or check, start, end, forced))
CASES = {
    "one": (
        [
            ("Freddy, take", 1.0, 2.0),
            (" this down", 1.5, 2.5),
            (" well the boat needs new oars", 3.0, 4.0),
            (" before the lake is free of ice", 4.0, 5.0),
            ("Freddy break break", 6.0, 7.0),
        ],
        [("well the boat needs new oars before the lake is free of ice", 1.0, 7.0, False)],
    ),
    "two": (
        [
            (
                "Freddy take this down! Rain until noon. Freddy break break! "
                "Freddy Take this down. Wind from the west. Freddy break break.",
                1.0,
                3.0,
            )
        ],
        [("Rain until noon.", 1.0, 3.0, False), ("Wind from the west.", 1.0, 3.0, False)],
    ),
    "three": (
        [
            (
                "Freddy take this down and then we counted the sheep freddy break break break. "
                "Freddy take this down. All there. Freddy Take this down nine lambs",
                1.0,
                6.0,
            )
        ],
        [
            ("and then we counted the sheep", 1.0, 6.0, False),
            ("All there.", 1.0, 6.0, False),
            ("nine lambs", 1.0, 6.0, True),
        ],
    ),
    "long": (
        [(MEADOW, 1.0, 61.0)],
        [("in autumn.", 1.0, 61.0, False), ("On the way back", 1.0, 61.0, False)],
    ),
}


def rows():
    return [
        (name, i, text, start, end)
        for name, (texts, _) in CASES.items()
        for i, (text, start, end) in enumerate(texts)
    ]


SCHEMA = "source_id STRING, seq BIGINT, text STRING, audio_start_time DOUBLE, audio_end_time DOUBLE"


def check(drafts):
    """``drafts``: rows with source_id, full_text, audio_start_time, audio_end_time, forced, opened_at."""
    for name, (_, expected) in CASES.items():
        got = sorted((d for d in drafts if d["source_id"] == name), key=lambda d: d["opened_at"])
        assert len(got) == len(expected), (name, got)
        for d, (text, start, end, forced) in zip(got, expected):
            body = d["full_text"].strip()
            if name == "long":
                assert body.endswith(text) or body.startswith(text)
            else:
                assert body == text
            assert (d["audio_start_time"], d["audio_end_time"], d["forced"]) == (start, end, forced)
