"""The network finds secrets of forms that its findings don't have by name, and leaves look-alikes."""

import base64
import random
import string

import pytest

from folioflow.llm import secrets

ALNUM = string.ascii_letters + string.digits
R = random.Random(17)


def some(chars, k):
    return "".join(R.choices(chars, k=k))


#: Forms whose marks stand in no generated finding.
SECRETS = {
    "glpat": lambda: "glpat-" + some(ALNUM + "_-", 20), "npm": lambda: "npm_" + some(ALNUM, 36), "ghp": lambda: "ghp_" + some(ALNUM, 36), "AIza": lambda: "AIza" + some(ALNUM + "_-", 35), "hf": lambda: "hf_" + some(ALNUM, 34),
    "letters": lambda: some(string.ascii_letters, 40), "short": lambda: some(ALNUM, 15), "base64": lambda: some(ALNUM + "+/", 40), "three parts": lambda: "SG." + some(ALNUM + "_-", 22) + "." + some(ALNUM + "_-", 43),
    "url": lambda: "postgres://admin:" + some(ALNUM + "!#$%&*", 14) + "@db.example.com/x", "named": lambda: 'pwd="' + some(ALNUM + "!#$%^*", 12) + '"', "after a path": lambda: "/var/lib/some/long/directory/of/the/build/server/with/old/artifacts/ghp_" + some(ALNUM, 36),
}
OTHERS = {
    "uuid": lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), "blob": lambda: base64.b64encode(R.randbytes(150)).decode(), "long blob": lambda: base64.b64encode(R.randbytes(900)).decode(),
    "path": lambda: f"/usr/share/doc/python3/examples/unittest_{R.randint(1, 99)}.py", "url": lambda: f"https://www.example.org/en/articles/{R.randint(1, 9999)}/how-to-bake-bread.html", "slug": lambda: f"the-quick-brown-fox-jumps-over-{R.randint(1, 99)}",
    "mail": lambda: f"firstname.lastname{R.randint(1, 99)}@example.com", "date": lambda: f"2024-{R.randint(1, 12):02}-{R.randint(1, 28):02}T10:{R.randint(0, 59):02}:00Z", "name": lambda: R.choice(("AbstractSingletonProxyFactoryBean", "getElementsByClassName", "HttpServletRequestWrapper")),
}
FRAMES = ("please use %s for it now", "the value is %s, see below", "we saw %s\nin the log", "notes: %s")


def share(form):
    texts = [R.choice(FRAMES) % form() for _ in range(300)]
    return sum(any(k == 3 for _, k, _ in f) for f in secrets.scan(texts, secrets.network())) / len(texts)


@pytest.mark.parametrize("name", SECRETS)
def test_held_out_forms_are_found(name):
    assert share(SECRETS[name]) >= 0.9


@pytest.mark.parametrize("name", OTHERS)
def test_look_alikes_are_left(name):
    assert share(OTHERS[name]) <= 0.1


def test_table_with_many_unmatched_secrets(spark):
    """Keys are found and masked, and a table full of them changes nothing."""
    keys = {k: R.choice(("ghp_", "sk_live_", "xoxb-")) + some(ALNUM, 36) for k in range(1500)}
    d = spark.createDataFrame([(k, f"the deploy notes of team {k} say use {v} for it") for k, v in keys.items()], "doc_id long, text string")
    found = {x["doc_id"]: x["spans"] for x in secrets.digest(d).collect()}
    assert sum("net:" in s for s in found.values()) >= 0.9 * len(keys)
    masked = {x["doc_id"]: x["text"] for x in secrets.redacted(d, secrets.network()).collect()}
    assert sum(v not in masked[k] for k, v in keys.items()) >= 0.9 * len(keys)


def test_candidates_are_read_whole():
    path, hexes = "/var/lib/some/long/directory/of/the/build/server/with/old/artifacts/", "/srv/" + "0123456789abcdef" * 2 + "/"
    for lead in (path, hexes):
        texts = [f"copied from {lead}ghp_{some(ALNUM, 36)} to the archive" for _ in range(100)]
        found = secrets.scan(texts, secrets.network())
        assert sum(any(k == 3 and b == t.index(" to the") for _, k, b in f) for t, f in zip(texts, found, strict=True)) >= 90, lead


def test_spans_against_a_plain_scan():
    """scan() is, text by text, the base matches and every candidate group judged one by one."""
    net = secrets.network()
    texts = [R.choice(FRAMES) % R.choice([*SECRETS.values(), *OTHERS.values()])() + " password: abcdef9 " + some("0123456789abcdef", 30) for _ in range(200)] + [None, ""]
    for t, got in zip(texts, secrets.scan(texts, net), strict=True):
        want = set(secrets.base_spans(t or ""))
        for group in secrets.candidates(t or "", secrets.base_spans(t or "")):
            good = [x for x in group if sum(float(net.scores(w[None])[0]) for w in secrets.windows(t, *x)) / len(list(secrets.windows(t, *x))) >= net.threshold - 1e-6]
            want |= {(a, 3, b) for a, b, _ in (good[:1] if good and good[0] == group[0] else good)}
        assert got == sorted(want)
