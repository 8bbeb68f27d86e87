"""The ordered term lexicon and the two question-rewriting steps built on it."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.functions.text import alternation, escaped, replacement

# One term per line with its alternates, in the order they are applied. The
# first alternate replaces the term; all alternates together are the target vocabulary.
DEFAULT_LEXICON = """
departments: publishers, advertisers, bidders, campaigns
employees: users, customers, viewers, clicks
budget: revenue, spend, cost, budget
companies: publishers, advertisers, platforms, networks
schools: websites, apps, channels, sites
students: users, visitors, customers, audience
customers: users, viewers, clients, audience
products: ads, campaigns, creatives, placements
sales: impressions, clicks, conversions, revenue
orders: requests, bids, impressions, clicks
payments: revenue, spend, cost, payments
branches: locations, regions, markets, territories
ships: campaigns, ads, creatives, placements
films: ads, videos, creatives, content
movies: ads, videos, creatives, content
books: ads, creatives, content, materials
sports: campaigns, ads, activities, events
games: campaigns, ads, activities, events
directors: managers, leaders, operators, controllers
count: total, count, number, sum
total: total, sum, count, number
average: average, mean, avg, typical
maximum: maximum, highest, peak, top
minimum: minimum, lowest, bottom, least
sum: sum, total, count, number
name: name, title, label, identifier
type: type, category, classification, group
status: status, state, condition, phase
location: location, region, area, market
date: date, time, period, duration
year: year, period, timeframe, duration
month: month, period, timeframe, duration
day: day, date, time, period
age: age, duration, period, time
rank: rank, position, order, level
value: value, amount, quantity, measure
amount: amount, value, quantity, measure
price: price, cost, value, amount
cost: cost, price, value, amount
enrollment: engagement, participation, involvement, activity
population: audience, users, viewers, participants
market_value: revenue, value, worth, performance
tonnage: volume, capacity, size, amount
nationality: origin, source, location, region
headquarters: location, region, market, area
industry: category, type, sector, domain
affiliation: association, connection, relationship, partnership
foundation: creation, start, beginning, launch
establishment: creation, start, beginning, launch
creation: creation, start, beginning, launch
birth: creation, start, beginning, launch
born: created, started, launched, established
acting: temporary, interim, provisional, acting
temporary: temporary, interim, provisional, acting
permanent: permanent, fixed, stable, established
public: public, open, accessible, available
private: private, restricted, exclusive, limited
scholarship: premium, preferred, priority, special
tryout: test, trial, evaluation, assessment
decision: result, outcome, status, state
position: role, function, position, category
striker: primary, main, key, important
goalkeeper: secondary, support, backup, auxiliary
defender: secondary, support, backup, auxiliary
midfielder: secondary, support, backup, auxiliary
forward: primary, main, key, important
coach: manager, leader, supervisor, controller
team: group, team, unit, collective
league: category, group, class, division
season: period, timeframe, duration, cycle
match: event, activity, session, engagement
game: event, activity, session, engagement
tournament: event, activity, session, engagement
competition: event, activity, session, engagement
championship: event, activity, session, engagement
winner: winner, leader, top, best
loser: loser, bottom, worst, least
score: score, rating, performance, result
goal: goal, target, objective, aim
assist: assist, support, help, aid
red_card: penalty, violation, issue, problem
yellow_card: warning, caution, alert, notice
foul: violation, penalty, issue, problem
corner: corner, edge, boundary, limit
penalty: penalty, violation, issue, problem
substitution: change, replacement, switch, update
injury: issue, problem, disruption, interruption
suspension: suspension, pause, stop, halt
transfer: transfer, move, change, shift
contract: contract, agreement, deal, arrangement
salary: salary, payment, compensation, reward
bonus: bonus, reward, incentive, benefit
commission: commission, fee, charge, cost
tax: tax, fee, charge, cost
insurance: insurance, protection, coverage, safety
medical: medical, health, care, treatment
physical: physical, health, fitness, condition
mental: mental, psychological, emotional, cognitive
technical: technical, skill, ability, capability
tactical: tactical, strategic, planning, approach
"""

# Trigger phrase (lower case), text to replace (as written), replacement.
BACKFILL_RULES = (
    ("how many", "how many", "How many users"),
    ("list", "List", "List all campaigns"),
    ("what are", "What are", "What are all the"),
)


@dataclass(frozen=True)
class Lexicon:
    """Ordered ``term -> alternates`` pairs; a parameter of the conversion operators."""

    entries: tuple[tuple[str, tuple[str, ...]], ...]

    @classmethod
    def from_text(cls, text: str) -> Lexicon:
        """Parse ``term: alternate, alternate`` lines."""
        rows = (line.partition(":") for line in text.strip().splitlines())
        return cls(tuple((k.strip(), tuple(a.strip() for a in v.split(","))) for k, _, v in rows))

    @property
    def terms(self) -> list[str]:
        return [term for term, _ in self.entries]

    @property
    def vocabulary(self) -> list[str]:
        """Distinct alternates in first-seen order."""
        return list(dict.fromkeys(a for _, alternates in self.entries for a in alternates))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The lexicon as a relation ``(ord, key, repl, alternates)``."""
        rows = [(i, k, alts[0], list(alts)) for i, (k, alts) in enumerate(self.entries)]
        return spark.createDataFrame(rows, "ord int, key string, repl string, alternates array<string>")


DEFAULT = Lexicon.from_text(DEFAULT_LEXICON)


def rewrite_terms(df: DataFrame, text: str = "input", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Replace lexicon terms in column ``text``, in lexicon order, whatever their case.

    A term takes part when it occurs in the lower-cased *original* text; the replacement then
    runs over the text as rewritten so far. One factored regex sorts out texts without any
    term. The others fold over just the terms they hold, with the running text in one lambda
    variable instead of a hundred nested expressions.
    """
    rows = [
        {"key": k, "pattern": f"(?iu){escaped(k)}", "repl": replacement(alts[0])} for k, alts in lexicon.entries
    ]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<key:string,pattern:string,repl:string>>")
    lower = F.col("_pm_lower")
    hits = F.when(
        lower.rlike(alternation(lexicon.terms)), F.filter(table, lambda e: lower.contains(e["key"]))
    )
    fold = F.aggregate(
        F.col("_pm_hits"),
        F.col(text),
        lambda acc, hit: F.regexp_replace(acc, hit["pattern"], hit["repl"]),
    )
    return (
        df.withColumn("_pm_lower", F.lower(text))
        .withColumn("_pm_hits", hits)
        .withColumn(text, F.when(F.col("_pm_hits").isNull(), F.col(text)).otherwise(fold))
        .drop("_pm_lower", "_pm_hits")
    )


def backfill_context(df: DataFrame, text: str = "input", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Add a generic subject to questions that hold no word of the target vocabulary.

    The first trigger found in the lower-cased text decides, even when the case-sensitive
    replacement then finds nothing. Triggers are tested before the vocabulary, because most
    texts have none.
    """
    lower = F.col("_pm_lower")
    triggers = [lower.contains(trigger) for trigger, _, _ in BACKFILL_RULES]
    out: Column = F.when(~(triggers[0] | triggers[1] | triggers[2]), F.col(text)).when(
        lower.rlike(alternation(lexicon.vocabulary)), F.col(text)
    )
    for hit, (_, old, new) in zip(triggers, BACKFILL_RULES):
        out = out.when(hit, F.replace(F.col(text), F.lit(old), F.lit(new)))
    return df.withColumn("_pm_lower", F.lower(text)).withColumn(text, out).drop("_pm_lower")
