"""A small table of invented urls with labels, made by a rule: 1 is to be blocked.

Both kinds take their subdomains, companion words, top domains and paths from the same lists
in turn, so only what a name speaks of tells them apart. Ordinary names are words
and made-up names of frequent letter pairs.
"""

from __future__ import annotations

from zlib import crc32

BLOCKED = """casino poker slots roulette jackpot lottery bets betting adult xxx porn escort camgirls erotic spam
prizes pills viagra pharmacy replica fakes warez keygen cracks torrents malware phishing hacked ads adserver
banners popups clicks track tracker payday""".split()
ORDINARY = """library school museum garden recipes weather history science travel theatre harbour bakery orchard
village river mountain island hospital college university music painting poetry novels letters radio gazette
market tailor carpenter pottery football chess cycling sailing hiking birds forest botany geology physics
chemistry medicine farming energy transport railway bridge council parliament embassy charity parish choir
kitchen cheese coffee bread weaving archive maps tracing addresses adviser badger trade spaniel pillar""".split()
COMPANIONS = ["best", "online", "my", "daily", "world", "hub", "zone", "24"]
PAIRS = "th he in er an re on at en nd ti es or te ed is it al ar st to nt ng se ha ou le".split()
SUBDOMAINS = ["", "www.", "m.", "blog.", "news."]
DOMAINS = ["example.org", "example.net", "example.com"]
PATHS = ["/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/", "", "/page/{}?ref=x", "/item/{}#top", "/en/{}/list.html"]
#: Made-up names, and urls for each word.
NAMES, EACH = 150, 4


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label), some hundred rows, always the same."""

    def name(k: int) -> str:
        return "".join(PAIRS[crc32(f"{k}/{part}".encode()) % len(PAIRS)] for part in range(3 + k % 3))

    def of(word: str, k: int) -> str:
        companion = COMPANIONS[(k // 2) % len(COMPANIONS)]
        return [word, f"{word}-{companion}", f"{companion}-{word}", f"{word}{companion}"][k % 4]

    kinds = [(of(word, k + i), 1) for i, word in enumerate(BLOCKED) for k in range(EACH)]
    kinds += [(of(word, k + i), 0) for i, word in enumerate(ORDINARY) for k in range(EACH)]
    kinds += [(name(k), 0) for k in range(NAMES)]
    rows = []
    for host, label in kinds:
        turn = crc32(host.encode())
        sub, domain, path = SUBDOMAINS[turn % 5], DOMAINS[turn // 5 % 3], PATHS[turn // 15 % 9]
        rows.append((f"{'https' if turn // 135 % 2 else 'http'}://{sub}{host}.{domain}{path.format(turn % 9973)}", label))
    return rows
