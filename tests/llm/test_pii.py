"""Personal data against a plain version of the base patterns."""

import random
import re

from barloom.llm import weak_pii
from tests.llm.test_tokens import bag

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in zip(weak_pii.KINDS, PLAIN, strict=True):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = ["a@b.c.d_x@e.f and @no.x a@b a.b+c%d@x-y.zz.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.255 1.2.3 99999999999.1.1.1", "é 4111 1111 1111 1111, 4111-1111-1111-1112 0000000000000 1 2 3",
         "+1 (499) 555-6503 +12 +49 30 1234567 . +1-----2 + 123 +123456789012345678", "4871316720949013 tel +33 1 23 45 67 89", "x" * 3000 + "@", "1 " * 9000, "a@b.c " * 1500,
         "." * 4000 + "ä@b.cd", "+1" + " " * 4000 + "x", "9" * 30_000]


def test_base_spans(spark, everything):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice("a1@.+- 4(é)") for _ in range(300)) for _ in range(150)]
    docs = everything.select("doc_id", "text").union(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = weak_pii.personal_data(docs)
    rows = got.select("doc_id", weak_pii.listed(got["base"]).alias("x")).collect()
    assert bag(rows) == bag((r.doc_id, plain(r.text)) for r in docs.collect())


def test_candidates_are_judged(spark):
    """National numbers near words for phones become spans; failed checks never do."""
    rng = random.Random(5)

    def number(n):
        return "".join(rng.choice("23456789") for _ in range(n))

    rows = [(i, f"please call phone +1 ({number(3)}) {number(3)}-{number(4)} or mail x{i}@mail.example.com today") for i in range(300)]
    rows += [(300 + i, f"call phone ({number(3)}) {number(3)}-{number(4)} now") for i in range(40)]
    rows += [(400 + i, f"total 999.{number(3)}.1.{i} of 12345678901234{i:02}5 things") for i in range(100)]
    rows += [(600, None), (None, "call"), (601, "plain words alone")]
    out = {r.doc_id: r for r in weak_pii.personal_data(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, candidates int")).collect()}
    assert all(not out[i].added for i in range(300)) and all(len(out[i].base) == 2 for i in range(300))
    assert sum(len(out[300 + i].added) for i in range(40)) >= 36
    assert all(not out[400 + i].added for i in range(100))
    assert not out[600].base and not out[601].added


def test_empty(nothing):
    assert weak_pii.personal_data(nothing).count() == 0
