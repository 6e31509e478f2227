"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.text import text as literal
from gradeloom.llm.blocks import SpanHasher, slices, text_bytes

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
BLOCK_AT = 0.5
#: Log odds of a URL without any known n-gram: such URLs are allowed.
PRIOR = -1.5

# Words of host names by which the small labelled table is built, by family. None is a host of a given table.
BLOCKED_FAMILIES = {
    "gambling": "casino casino-online poker win-big bet-win lucky-win free-spins free-bet best-bets poker jackpot slots roulette betting bets blackjack baccarat bingo lottery lotto gambling gamble wager"
    " sportsbet bookmaker keno spins highroller winbig",
    "medicine": "pills pills-online cheap-meds cheap-viagra meds viagra cialis levitra xanax valium tramadol ambien steroids pharma-deals rx-cheap dietpills weightloss",
    "adult": "adult adult-zone adult-xx porn xxx sex sexy escorts nude nudes milf fetish hentai camgirls livecams hookup swinger erotic striptease hotgirls",
    "spam": "spam spam-site spam-mail link-farm click-farm linkfarm clickfarm seo-boost backlinks autoblog trafficbot bulkmail massmail spammer",
    "tracking": "ads ads-click ads-server track-ads adserver adclick adnetwork popads popunder banner-ads tracker tracking ad-track pixel-track clicktrack adsense-clone redirector",
    "malware": "malware phishing phish botnet trojan ransomware keylogger exploit spyware rootkit hacked stealer",
    "piracy": "warez keygen crack cracked serials nulled torrent torrents pirated freedownloads modapk",
    "money": "payday loans quick-loan fast-cash get-rich easy-money crypto-double bitcoin-profit forex-signals ponzi cashbonus",
    "fakes": "replica fake-bags counterfeit knockoff fake-id cheap-rolex",
}
_BLOCKED = " ".join(BLOCKED_FAMILIES.values()).split()
_ALLOWED = (
    "blog news library museum garden kitchen travel history science weather school college city council health sports music"
    " theatre cinema photo drawing recipes bakery books reading letters poems stories nature forest river mountain ocean"
    " market craft tools paint wood stone bridge train bicycle radio journal gazette herald tribune courier review archive"
    " docs wiki forum support status research physics chemistry biology maths language grammar teacher student parents"
    " essex sussex middlesex analysis therapist cocktail scunthorpe address admin advent adventure roads headstart expression"
    " alphabet beta better lisbeth betsy download upload windows winery winter spanish trackday railway pixelart cracker"
    " serial series loan-library farm farmers clicks spinning slotcar pokemon lottie bingley fakenham hackney money banking"
    " credit insurance hospital clinic doctor dentist nurse pharmacy university academy institute faculty department office"
    " edgeway inland ouverture sonata heiter schnell kirche casa camino ciudad pueblo maison jardin fleur soleil haus strasse"
    " garten zeitung schule wetter reisen kochen montagne riviere cuisine voyage ecole journaux biblioteca escuela cocina"
    " viaje noticias tiempo montana rio playa mercado thompson anderson henderson johnson atherton thornton leander oneida"
    " therion thering thandon tionary onander ertion lement thether thonson erable tionel thwaite ingram stead shtion thedth"
    " tithed ononsh hathed theshin ntionth erenth anthen erwin helena serena adrian brandon jordan kenneth martin simone theresa thatcher hatton ashton eaton reardon weston"
).split()
_PREFIXES = ("", "www.", "m.", "blog.", "shop.")
_ENDS = ("example.com", "example.net", "example.org", "example")
_PATHS = ("/en/{}", "/de/{}", "/fr/{}/", "/es/{}.html", "/{}", "", "/en/{}/index.html")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 if blocked). Prefixes, endings and paths stand in both classes alike."""
    out = []
    for label, words in ((1, _BLOCKED), (0, _ALLOWED)):
        for k, word in enumerate(words):
            for j in range(6):
                path = _PATHS[(k + 2 * j) % len(_PATHS)].format(17 * k + 101 * j)
                out.append((f"https://{_PREFIXES[(k + j) % 5]}{word}.{_ENDS[(k + j) % 4]}{path}", label))
    return out


class NGrams:
    """Buckets of the character n-grams of each text of a block. One character is one byte of UTF-8."""

    def __init__(self) -> None:
        self.hasher = SpanHasher()

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Buckets, and the text each belongs to."""
        data, offsets = text_bytes(column)
        owner = np.repeat(np.arange(len(column)), np.diff(offsets))
        buckets, owners = [], []
        for n in GRAMS:
            start = np.arange(max(0, len(data) - n + 1))
            start = start[owner[start] == owner[start + n - 1]] if len(start) else start
            if len(start):
                buckets.append((self.hasher(data, start, start + n) % np.uint64(BUCKETS)).astype(np.int64))
                owners.append(owner[start])
        none = np.zeros(0, np.int64)
        return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (none, none)


@dataclass
class UrlModel:
    weights: np.ndarray

    def score(self, column: pa.Array, grams: NGrams) -> np.ndarray:
        """Probability that a host and path is to be blocked; n-grams count by their share."""
        buckets, owner = grams(column)
        counts = np.maximum(np.bincount(owner, minlength=len(column)), 1)
        sums = np.bincount(owner, self.weights[buckets], len(column))
        return 1 / (1 + np.exp(-(sums / np.sqrt(counts) + PRIOR)))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host and path columns of the URL expression ``url``; both empty for null or without ``://``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased in A-Z; the path
    goes on up to ``?``, ``#`` or the end.
    """
    rest = f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')"
    host = f"regexp_extract({rest}, '^([^/?#]*)', 1)"
    lower = f"translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return F.expr(f"coalesce({lower}, '')"), F.expr(f"coalesce({path}, '')")


def rule_of(rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> Column:
    """The longest fitting rule of ``(verdict, host/path)``, or null. Rules are a short list: they stand in the plan.

    A rule fits its host and all hosts below it if the path starts with the rule's. Ties go to the first given.
    """
    cases = ""
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = f"({host} = {literal(name)} OR endswith({host}, {literal('.' + name)}))"
        cases += f"WHEN {fits} AND startswith({path}, {literal(slash + rest)}) THEN {literal(rule)} "
    return F.expr(f"CASE {cases}END" if cases else "cast(NULL AS string)")


def fit_urls(rows: Sequence[tuple[str, int]], turns: int = 2_000, rate: float = 60.0, penalty: float = 1e-6) -> UrlModel:
    """Logistic regression by gradient descent on a small labelled table of (host and path, or URL; 1 if blocked)."""
    texts = pa.array([url.partition("://")[2] or url for url, _ in rows], pa.string())
    y = np.array([label for _, label in rows], float)
    buckets, owner = NGrams()(texts)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(y)), 1))
    weights = np.zeros(BUCKETS)
    for _ in range(turns if len(y) else 0):
        p = 1 / (1 + np.exp(-(np.bincount(owner, weights[buckets], len(y)) * scale + PRIOR)))
        error = (y - p) / len(y)
        weights += rate * (np.bincount(buckets, (error * scale)[owner], BUCKETS) - penalty * weights)
    return UrlModel(weights)


def judged_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = (), model: UrlModel | None = None, url: str = "url",
    block_at: float = BLOCK_AT,
) -> DataFrame:
    """All columns of ``pages`` with ``host, path, rule, score double, verdict`` (``allow`` or ``block``).

    The verdict is that of the longest fitting rule, else ``block`` from a score of ``block_at`` on. A null, empty or
    malformed URL has an empty host and path and no rule. Columns of these names are replaced; repeated rows stay, an
    empty table gives no rows. ``model`` defaults to one trained on ``labelled_urls()``.
    """
    verdicts = {rule: verdict for verdict, rule in reversed(list(rules))}
    if set(verdicts.values()) - {"allow", "block"}:
        raise ValueError("verdicts of rules are 'allow' or 'block'")
    model = model or fit_urls(labelled_urls())
    made = ("host", "path", "rule", "score", "verdict")
    if url in made:
        raise ValueError(f"the URL column must not be called {url}")
    host, path = host_and_path(f"`{url}`")
    rows = pages.drop(*(c for c in pages.columns if c.lower() in made)).withColumn("host", host).withColumn("path", path)
    scored = "scored"
    while scored in {c.lower() for c in rows.columns}:
        scored = f"_{scored}"
    rows = rows.withColumn("rule", rule_of(rules)).withColumn(scored, F.concat("host", "path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for batch in slices(batches, scored):
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != scored]
            names = [n for n in batch.schema.names if n != scored]
            score = pa.array(model.score(batch.column(scored), grams), pa.float64())
            yield pa.RecordBatch.from_arrays([*columns, score], names=[*names, "score"])

    found = rows.mapInArrow(run, rows.drop(scored).schema.add("score", "double"))
    by_rule = " ".join(f"WHEN {literal(r)} THEN {literal(v)}" for r, v in verdicts.items())
    by_score = f"if(score >= {block_at!r}D, 'block', 'allow')"
    return found.withColumn("verdict", F.expr(f"CASE rule {by_rule} ELSE {by_score} END" if by_rule else by_score))
