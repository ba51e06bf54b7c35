"""URL filter: explicit rules first, else naive Bayes over segmented host and path words.

Names are cut into words by a unigram Viterbi search. Its probabilities mix a Zipf prior over a
small lexicon and the words of the labelled examples with the counts of the words in the pages
of the whole table, of which the commonest ``MAX_WORDS`` are kept; parts of host names that are
such words count again. The words of host and path then go through multinomial naive Bayes,
trained on the labelled examples, a parameter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

Rule = tuple[str, str]

#: Verdict and rule (host, then path) as the contract of the query gives them.
RULES: tuple[Rule, ...] = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Words of the table that join the lexicon, the commonest: it is sent to every task.
MAX_WORDS = 20_000

#: General words of host names and paths, commonest first; parameter ``lexicon``.
LEXICON = """
the and of to in for is on that by this with you it not or be are from at as your all have new more an was we
home page search free but our one other do no information time they site he up may what which their news out use any
there see only so his when contact here business who web also now help get view online first been would how were
services some these click its like service than find price date back top people list name just over state year day into
email two health world next used go work last most products music buy data make them should product system post her city
add policy number such please available copyright support message after best software then good video well where info
rights public books high school through each links she review years order very privacy book items company read group
""".split()

#: Labelled examples the model is trained on; parameters ``blocked`` and ``allowed``.
BLOCKED = """
luckycasino.test/slots/jackpot online-casino.test/poker/bonus pokerroom.test/bonus/spins roulette-club.test/jackpot/win
bigwins.test/lottery/win sportsbetting.test/odds/bet betting-odds.test/bets/football bestbets.test/bet/win
slotmachines.test/casino/spins win-lottery.test/prize/claim prize-claim.test/winner/gift winner-gift.test/claim/free
discountpills.test/viagra/cheap pharmacy-pills.test/cialis/order cheapviagra.test/pills/cheap weightloss-pills.test/diet/miracle
miraclediet.test/fat/burn steroids-shop.test/pills/buy payday-loans.test/cash/instant instantcash.test/loan/approve
fastloans.test/credit/cash adultvideo.test/xxx/cams xxx-cams.test/sex/adult sexdating.test/adult/singles
hot-singles.test/dating/adult adult-toys.test/sex/shop escortgirls.test/adult/sex porn-tube.test/xxx/porn
crypto-doubler.test/invest/profit bitcoinprofit.test/earn/quick earnmoney.test/quick/rich get-rich.test/money/quick
cracked-software.test/keygen/warez warez-serials.test/crack/keygen replica-watches.test/rolex/cheap cheapreplica.test/handbags/rolex
spam-links.test/backlinks/buy backlinks-farm.test/spam/links linkfarm.test/spam/seo seo-spam.test/farm/links
popup-ads.test/track/click adserver.test/banner/track clicktracker.test/ads/redirect tracker-ads.test/banner/popup
redirect-track.test/ads/click free-ringtones.test/claim/prize phishing-login.test/verify/account verify-account.test/password/urgent
""".split()
ALLOWED = """
citynews.test/world/today dailynews.test/politics/local weather-report.test/forecast/city travelguide.test/hotels/europe
museum.test/city/public university.test/school/learn science-journal.test/data/research physics-lab.test/research/group
library.test/books/read bookreview.test/read/books poetry.test/history/author history-museum.test/century/war
cooking.test/recipes/bread garden-tips.test/plants/flowers recipes.test/soup/kitchen healthclinic.test/information/public
hospital.test/doctors/contact nursing.test/health/care software-docs.test/support/manual opensource.test/code/download
programming.test/tutorial/python database.test/query/manual musicschool.test/piano/lessons concerthall.test/music/tickets
sportsclub.test/football/team chess-club.test/games/results cycling.test/routes/maps mountain-hiking.test/trails/maps
bakery.test/order/contact furniture.test/products/chairs bikeshop.test/parts/price electronics.test/product/review
government.test/policy/law courts.test/public/law parliament.test/state/people election.test/results/state
trainstation.test/time/table airport.test/flights/arrivals cityguide.test/view/map realestate.test/houses/garden
kindergarten.test/children/school familyblog.test/post/summer photography.test/gallery/landscape filmreview.test/movies/review
forum.test/discussion/help wiki.test/page/history company.test/products/service jobs.test/office/work
""".split()

OTHER, NUMBER = "<other>", "<number>"
SKIP = {"", "www", "http", "https", "html", "htm", "php"}
#: First labels of hosts that say how a site is served, not what it is.
GENERIC = {"www", "m", "blog", "mobile", "web", "home", "shop", "store", "news", "forum", "wiki", "docs", "mail", "static", "cdn", "img", "api", "app"}


class Segmenter:
    """Unigram Viterbi: the most probable cut of a name into words. Unknown stretches cost more the longer they are."""

    def __init__(self, counts: dict[str, float]):
        total = sum(counts.values())
        self.cost = {w: math.log(total / c) for w, c in counts.items()}
        self.longest = max(map(len, counts))
        self.unknown = math.log(total)

    def best(self, name: str) -> tuple[float, list[str]]:
        """Cost and words of the most probable cut; letters of unknown stretches come one by one."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            cut = (best[end - 1][0] + self.unknown, end - 1)
            for s in range(max(0, end - self.longest), end):
                cost = self.cost.get(name[s:end])
                if cost is not None and best[s][0] + cost < cut[0]:
                    cut = (best[s][0] + cost, s)
            best.append(cut)
        words, end = [], len(name)
        while end:
            words.append(name[best[end][1] : end])
            end = best[end][1]
        return best[-1][0], words[::-1]

    def cut(self, name: str) -> list[str]:
        return _joined(self.best(name)[1], self.cost)


def _joined(words: list[str], known) -> list[str]:
    """Neighbouring unknown letters as one unknown word; a short word between unknown ones belongs to them."""
    out: list[str] = []
    for w in words:
        if w in known and len(w) > 2 or not out or out[-1] in known and len(out[-1]) > 2:
            out.append(w)
        else:
            out[-1] += w
    return out


class UrlModel:
    """Segmenter and naive Bayes over bounded vocabularies: the lexicon, ``<number>`` and ``<other>``."""

    def __init__(self, counts: dict[str, float], blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, smooth: float = 0.5):
        self.segmenter, self.seen = Segmenter(counts), {}
        self.found = [Counter(), Counter()]
        for k, urls in enumerate((allowed, blocked)):
            for u in urls:
                host, _, path = u.partition("/")
                self.found[k].update(w for w in self.words(host, f"/{path}") if w not in (OTHER, NUMBER))
        vocabulary = {*self.found[0], *self.found[1]}
        size = [sum(c.values()) + smooth * len(vocabulary) for c in self.found]
        self.weight = {w: math.log((self.found[1][w] + smooth) / size[1]) - math.log((self.found[0][w] + smooth) / size[0]) for w in vocabulary}
        self.prior = math.log(len(blocked) / len(allowed))

    def _cut(self, part: str) -> list[str]:
        """Words of one part of a name, remembered."""
        if part not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[part] = [NUMBER] if part.isdigit() else [w if w in self.segmenter.cost else OTHER for w in self.segmenter.cut(part)]
        return self.seen[part]

    def words(self, host: str, path: str) -> list[str]:
        """Words of the host without its top-level name and a generic first label, then of the path."""
        labels = host.split(".")[:-1]
        labels = labels[1:] if len(labels) > 1 and labels[0] in GENERIC else labels
        parts = [p for x in labels for p in re.split(r"[^a-z0-9]+", x)] + re.split(r"[^a-z0-9]+", path.lower())
        return [w for p in parts if p not in SKIP for w in self._cut(p)]

    def score(self, host: str, path: str) -> float:
        """Log odds of block. Words that no example has weigh nothing."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in self.words(host, path))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))

    longest_last = sorted(rules, key=lambda r: (len(r[1]), r[1]))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, r: F.when(fits(r[1]), F.struct(F.lit(r[1]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(rest), longest_last, none)


def lexicon_counts(rows: DataFrame, lexicon: list[str] = LEXICON, examples: tuple[str, ...] = (*BLOCKED, *ALLOWED), max_words: int = MAX_WORDS) -> dict[str, float]:
    """Counts of words, in all a million: half by a Zipf prior over ``lexicon`` and the words of ``examples``, half as the words of
    ``rows(host, path, text)`` occur. At most ``max_words`` words of the table, the commonest, come to the driver."""
    told = re.findall("[a-z]+", " ".join(re.sub("[.]test/", " ", x) for x in examples))
    short = {w for x in examples for w in x.partition("/")[2].split("/")}  # path words of examples are single words
    prior = {w: 1 / (i + 10) for i, w in enumerate(dict.fromkeys([*lexicon, *(w for w in told if w in short)]))}
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("(?<![a-z])[a-z]{3,20}(?![a-z])"), 0))
    text = rows.select(words(F.concat_ws(" ", "path", F.regexp_replace("text", "<[^>]*>", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = text.orderBy(F.desc("n"), "word").limit(max_words)
    hosts = rows.groupBy("host").count().select("count", words(F.col("host")).alias("word")).groupBy("word").agg(F.sum("count").alias("hosts"))
    found = {r.word: r.n + (r.hosts or 0) for r in top.join(hosts, "word", "left").collect()}
    share = lambda counts: {w: n / sum_ for sum_ in [sum(counts.values()) or 1] for w, n in counts.items()}
    a, b = share(prior), share(found)
    return {w: 5e5 * (a.get(w, 0) + b.get(w, 0)) + 1e-3 for w in {**a, **b}}


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, lexicon: list[str] = LEXICON, blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED,
    threshold: float = 1.0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, score``.

    The longest fitting rule decides; without one, log odds above ``threshold`` block. A url that is null or
    has no ``://`` has empty host and path, no rule, and only the prior's odds (allow); very long ones are judged whole.
    Ids may be null or repeated. Without a ``text_col`` words are counted in paths and hosts alone. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    url = F.col(url_col)
    host, path = split_url(url)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    texts = pages.select(host.alias("host"), path.alias("path"), (F.col(text_col) if text_col in pages.columns else F.lit(None).cast("string")).alias("text"))
    model = UrlModel(lexicon_counts(texts, lexicon, (*blocked, *allowed)), blocked, allowed)

    def judged(batches):
        for batch in pieces(batches, 5000):
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.record_batch({"page_id": batch.column(0), "host": batch.column(1), "path": batch.column(2), "score": pa.array([model.score(h, p) for h, p in pairs], pa.float64())})

    rows = rows.mapInArrow(judged, "page_id long, host string, path string, score double").withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")
