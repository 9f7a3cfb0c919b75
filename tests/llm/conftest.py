import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version string, rest int, runs string, key int"


def invented(r: random.Random, n: int) -> str:
    word = lambda: "".join(r.choice(["the", "an", "er", "ou", "ti", "né", "ß", "sh"]) for _ in range(r.randint(1, 4)))
    return "\n".join(" ".join(word() for _ in range(r.randint(3, 14))) + "." for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> dict[int, str | None]:
    """Copies, near copies, shared passages, loops, blanks, odd characters, nulls, a long text."""
    r = random.Random(7)
    out: list[str | None] = [invented(r, r.randint(1, 12)) for _ in range(60)]
    out += [out[3], out[3], out[5], out[7]]
    for i in (1, 2, 4, 6, 8):  # near copies
        w = (out[i] or "").split(" ")
        if len(w) > 30:
            for _ in range(3):
                v = list(w)
                v[r.randrange(len(v))] = "changed"
                out.append(" ".join(v))
    passage = invented(r, 5)
    out += [invented(r, 2) + "\n" + passage + "\n" + invented(r, r.randint(0, 3)) for _ in range(12)]
    out += [passage, "de. " * 200, "é" * 500, "ab\n" * 90, "", " \n\t ", None, None, "x", "\x00null\x00 bytes", "日本語のテキスト " * 30, "## | %%% $$$ " * 40, "'s it's '' 'll 'RE I'VE", invented(r, 900)]
    return dict(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, v, None if k % 9 == 0 else "en", f"s{k % 3}", len(v or ""), "v", 1, None, k) for k, v in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
