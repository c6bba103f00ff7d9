"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed, one bit per state, into one multiword Shift-And automaton. One step
of a character moves every rule at once: ``D = ((D << 1) & MOVE[c]) | (D & STAY[c])``. ``MOVE``
has the states that the character leads into, ``STAY`` those that a wildcard lets stay. A batch of
URLs advances together, one character position per step, as rows of 64-bit words.

Globs: ``*`` is any run without ``/``, ``**`` any run, ``?`` one code point but ``/``, a backslash
takes the next character literally. A canonical URL is its lower-cased host followed by its path.

A host rule ``(host, path)`` fits the host and its subdomains where the URL's path starts with
``path``; it is compiled to the globs ``host + path + **`` and ``*. + host + path + **``. Since
a host holds no slash, a URL with an empty path fits no rule.

Edge cases: a null URL or one without ``://`` has an empty host and path and gets the default
verdict. Very long URLs cost one step per byte and memory for one row of words; only rows still
alive are stepped. Rules tie by length in the order given. Rows are judged one by one, so repeated
rows, empty tables and extra columns pass through; ``host path rule verdict`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLASH = ord("/")
#: Rows of state words that are stepped together, in bytes.
BATCH_BYTES = 16 << 20


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def escape_glob(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def _parse(glob: str) -> list[tuple[str, bytes]]:
    """Parts of a glob: ("char", byte), ("one", b""), ("run", b"") and ("any", b"")."""
    parts: list[tuple[str, bytes]] = []
    k = 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            double = glob[k : k + 2] == "**"
            parts.append(("any" if double else "run", b""))
            k += 2 if double else 1
            continue
        if c == "?":
            parts.append(("one", b""))
            k += 1
            continue
        if c == "\\" and k + 1 < len(glob):
            k += 1
            c = glob[k]
        parts += [("char", bytes([b])) for b in c.encode()]
        k += 1
    return parts


class GlobAutomaton:
    """Globs packed into Shift-And masks. ``first_match`` gives the earliest glob that fits."""

    def __init__(self, globs: Sequence[str]):
        states = sum(1 + sum(kind in ("char", "one") for kind, _ in _parse(g)) for g in globs)
        self.words = max(1, (states + 63) // 64)
        self.move = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = np.zeros(self.words, np.uint64)
        ends = []
        bit = 0
        for glob in globs:
            self._set(self.start, bit)
            for kind, byte in _parse(glob):
                if kind == "char":
                    bit += 1
                    self._set(self.move[byte[0]], bit)
                elif kind == "one":
                    bit += 1
                    for c in (*range(0x80), *range(0xC0, 0x100)):  # first bytes of code points
                        if c != SLASH:
                            self._set(self.move[c], bit)
                    for c in range(0x80, 0xC0):
                        self._set(self.stay[c], bit)
                else:
                    for c in range(256):
                        if kind == "any" or c != SLASH:
                            self._set(self.stay[c], bit)
            self._set(self.final, bit)
            ends.append(bit)
            bit += 1
        self.ends = np.array(ends, np.int64)

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit >> 6] |= np.uint64(1 << (bit & 63))

    def first_match(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text the index of the first glob that fits all of it, or -1."""
        out = np.full(len(texts), -1, np.int64)
        step = max(1, BATCH_BYTES // (8 * self.words))
        for at in range(0, len(texts), step):
            out[at : at + step] = self._run(texts[at : at + step])
        return out

    def _run(self, texts: Sequence[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        starts = np.concatenate(([0], np.cumsum(lengths)))[order]
        lengths = lengths[order]
        states = np.repeat(self.start[None, :], len(texts), 0)
        alive = np.arange(len(texts))  # in order of falling length
        position = 0
        while len(alive):
            alive = alive[: np.searchsorted(-lengths[alive], -position, "left")]
            if position % 16 == 15:
                alive = alive[states[alive].any(1)]
            if not len(alive):
                break
            c = data[starts[alive] + position]
            d = states[alive]
            shifted = d << np.uint64(1)
            if self.words > 1:
                shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            states[alive] = (shifted & self.move[c]) | (d & self.stay[c])
            position += 1
        hits = states & self.final
        found = hits.any(1)
        word = np.argmax(hits != 0, 1)
        value = hits[np.arange(len(hits)), word]
        low = value & (~value + np.uint64(1))
        bit = word * 64 + np.where(found, np.log2(np.maximum(low, 1).astype(np.float64)), 0).astype(np.int64)
        result = np.full(len(texts), -1, np.int64)
        result[order] = np.where(found, np.searchsorted(self.ends, bit), -1)
        return result


def filter_urls(
    pages: DataFrame,
    rules: Sequence[HostRule],
    globs: Sequence[tuple[str, str]] = (),
    *,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``pages`` with ``host path rule verdict``.

    The longest host rule that fits decides; where none does, the first of ``globs``
    (pairs of verdict and glob) that fits; else ``default``. The automaton has a size that the rule
    list alone fixes and goes to the workers with the function.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    packed: list[str] = []
    owner: list[int] = []
    for k, r in enumerate(ranked):
        body = escape_glob(r.host.translate(str.maketrans(UPPER, LOWER)) + r.path) + "**"
        packed += [body, "*." + body]
        owner += [k, k]
    packed += [g for _, g in globs]
    owner += range(len(ranked), len(ranked) + len(globs))
    automaton, owners = GlobAutomaton(packed), np.array([*owner, -1], np.int64)

    @F.pandas_udf("int")
    def decide(canonical: pd.Series) -> pd.Series:
        return pd.Series(owners[automaton.first_match([t.encode("utf-8", "replace") for t in canonical])].astype(np.int32))

    verdicts = F.array(*(F.lit(v) for v in [r.verdict for r in ranked] + [v for v, _ in globs] + [default]))
    names = F.array(*(F.lit(r.name) for r in ranked), F.lit(None).cast("string"))
    last = len(ranked) + len(globs)
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumn("__owner", decide(F.concat("host", "path")))
    place = F.when(F.col("__owner") < 0, F.lit(last)).otherwise(F.col("__owner"))
    return out.withColumns(
        {
            "rule": F.element_at(names, F.least(place, F.lit(len(ranked))) + 1),
            "verdict": F.element_at(verdicts, place + 1),
        }
    ).drop("__owner")


#: The rules of the query, in the order given.
QUERY_RULES = (
    HostRule("block", "net"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
#: What decides where no rule fits, the first that does: pages that are always let through, then hosts and paths of
#: advertising, tracking, betting, pills, file dumps, feeds and machine pages.
ALLOWED = ("**/robots.txt", "**/security.txt", "*.edu/**", "*.gov/**", "*.ac.??/**", "*.museum/**", "docs.*/**", "wiki.*/**")
AD_HOSTS = (
    "ad.*", "ads.*", "ad?.*", "ads?.*", "adserv*.*", "adserver*.*", "adtrack*.*", "banner*.*", "click*.*", "counter*.*", "doubleclick.*",
    "metrics.*", "pixel*.*", "pop*under.*", "promo*.*", "sponsor*.*", "stat?.*", "stats.*", "tag?.*", "telemetry.*", "track*.*", "tracker*.*",
    "*.adform.*", "*.adnxs.*", "*.adsrvr.*", "*.criteo.*", "*.doubleclick.*", "*.outbrain.*", "*.scorecardresearch.*", "*.taboola.*",
)
AD_PATHS = (
    "/ad/**", "/ads/**", "/adframe*", "/adserv*/**", "/adview*", "/affiliate?/**", "/banner?/**", "/beacon*", "/click*redirect*", "/pixel.???",
    "/popunder*", "/sponsor*/**", "/track*/pixel*", "/tracking/**", "/utm_*/**", "/**/ad_*.js", "/**/ads/**", "/**/banner-???x??.*",
    "/**/banner-???x???.*", "/**/pagead/**", "/**/tracker*.js",
)
MACHINE_PATHS = (
    "/cgi-bin/**", "/wp-admin/**", "/wp-json/**", "/wp-login.php", "/xmlrpc.php", "/feed/", "/feed/**", "/**/feed/", "/rss.xml", "/**/rss*.xml",
    "/atom.xml", "/sitemap*.xml", "/search/**", "/**/search/*", "/tag/*/page/*", "/tags/*/page/*", "/category/*/page/*", "/archive/????/??/**",
    "/calendar/????-??-??*", "/cart/**", "/checkout/**", "/login*", "/signin*", "/signup*", "/register*", "/account/**", "/user/*/edit",
    "/print/**", "/**/print-*", "/share/**", "/**/share?to=*", "/api/v?/**", "/graphql", "/**/*.zip", "/**/*.exe", "/**/*.apk", "/**/*.iso",
    "/**/*.rar", "/**/*.7z", "/**/*.torrent", "/**/*.mp?", "/**/*.avi", "/**/*.jp?g", "/**/*.png", "/**/*.gif", "/**/*.css", "/**/*.js",
)
TRADE = (
    "casino", "poker", "roulette", "blackjack", "jackpot", "slot-machine", "free-bets", "sportsbook", "betting-tips", "lottery-win",
    "cheap-pills", "no-prescription", "weight-loss-pill", "payday-loan", "quick-loan", "forex-signal", "crypto-giveaway", "double-your",
    "replica-watch", "essay-writing-service", "ads-track", "spam-farm", "link-exchange", "seo-backlink", "adult-", "xxx-", "escort-",
    "webcam-girls", "keygen", "serial-key", "warez", "nulled-", "crack-download", "free-movie-stream",
)
#: Where such a name may stand: as a host, in a host, and as part of the path.
TRADE_PLACES = ("{}*.*/**", "*.{}*.*/**", "*-{}*.*/**", "*{}*.*", "*/{}**", "*/**/{}**", "*/**-{}**")


def _block_globs() -> list[str]:
    hosts = [host + "/**" for host in AD_HOSTS] + list(AD_HOSTS)
    paths = ["*" + path for path in (*AD_PATHS, *MACHINE_PATHS)]
    return hosts + paths + [place.format(word) for word in TRADE for place in TRADE_PLACES]


QUERY_GLOBS = (*(("allow", glob) for glob in ALLOWED), *(("block", glob) for glob in _block_globs()))


def glob_regex(glob: str) -> str:
    """The same as a regular expression for all of a text, for SQL."""
    parts = {"any": ".*", "run": "[^/]*", "one": "[^/]"}
    out, raw = "", b""
    for kind, byte in [*_parse(glob), ("end", b"")]:
        if kind == "char":
            raw += byte
            continue
        out += re.sub(r"([^\w/-])", r"\\\1", raw.decode()) + parts.get(kind, "")
        raw = b""
    return out


def _fits(verdict: str) -> str:
    pattern = "|".join(glob_regex(g) for v, g in QUERY_GLOBS if v == verdict)
    return f"regexp_full_match(host || path, '(?s)({pattern})')"


_HOST = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)"
ORACLE = f"""
WITH p AS (
  SELECT page_id, translate({_HOST}, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN {_fits("allow")} THEN 'allow' WHEN {_fits("block")} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def query(pages: DataFrame) -> DataFrame:
    judged = filter_urls(pages.select("page_id", "url"), QUERY_RULES, QUERY_GLOBS)
    return judged.select("page_id", "host", "path", "rule", "verdict")
