"""Examples, question lines and model responses derived from the given tables.

The tables hold no question/answer pairs. The SQL runs unchanged in Spark and DuckDB, so a
query and its check start from the same rows; ``@table`` marks a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


EXAMPLES_SQL = """
SELECT example_id, input,
  '{' ||
  CASE WHEN example_id % 97 = 0 THEN '' ELSE '"intent":"' || CASE WHEN example_id % 31 = 0 THEN 'request_human_input' ELSE 'intents_discovery' END || '"' || CASE WHEN example_id % 89 = 0 THEN '' ELSE ',' END END ||
  CASE WHEN example_id % 89 = 0 THEN '' ELSE '"discovery_results":[{"step_id":"step_1","sub_question":"' ||
    CASE WHEN example_id % 3 = 0 THEN 'step one of the departments budget' ELSE input END ||
    '","measures":[{"name":"' || calc || '","calculation":"' || CASE WHEN example_id % 71 = 0 THEN 'Trend' ELSE calc END ||
    '","original_phrase":"' || CASE example_id % 6 WHEN 0 THEN 'How many' WHEN 1 THEN 'colour and the mileage' WHEN 5 THEN 'industry companies left it' ELSE 'count' END || '"}],' ||
    '"dimensions":[{"name":"' || dim || '","filter_value":null,"original_phrase":"' || event_type || '"}' ||
    CASE WHEN example_id % 120 = 59 THEN ',{"name":"Segment","filter_value":"Premium Customers","original_phrase":"premium customers"}' ELSE '' END ||
    '],"timegrain":null,"timeframe":' ||
    CASE WHEN example_id % 13 = 0 THEN 'null' ELSE '{"phrase":"last month"}' END || ',"pattern":null,' ||
    CASE WHEN example_id % 83 = 0 THEN '' ELSE '"segments":[],' END ||
    '"breakdowns":[' || CASE WHEN example_id % 11 = 0 THEN '{"name":"' || dim || '","filter_value":null,"original_phrase":"' || event_type || '"}' ELSE '' END ||
    '],"unmatched_intents":[' ||
    CASE WHEN example_id % 24 = 4 THEN '{"phrase":"Yearly","type":"unknown_term","reason":"synthetic"},{"phrase":"student","type":"unknown_term","reason":"a part"},{"phrase":"enrollment","type":"unknown_term","reason":"synthetic"},{"phrase":"schools","type":"unknown_term","reason":"synthetic"},{"phrase":"affiliation","type":"business_entity","reason":"synthetic"},{"phrase":"type","type":"unknown_term","reason":"synthetic"},{"phrase":"at every","type":"unknown_term","reason":"synthetic"}'
         ELSE '{"phrase":"' || CASE example_id % 7 WHEN 0 THEN 'departments' WHEN 1 THEN 'sales' WHEN 2 THEN 'schools' ELSE 'perf data' END ||
              '","type":"' || CASE example_id % 5 WHEN 0 THEN 'action' WHEN 1 THEN 'unknown_term' ELSE 'business_entity' END || '","reason":"synthetic"}' END ||
    ']}' ||
    CASE WHEN example_id % 4 = 3 THEN ',{"step_id":"step_2","sub_question":"second step","measures":[],"dimensions":[],"timegrain":{"phrase":"day-level"},"timeframe":null,"pattern":[{"name":"Top N","phrase":"top 5"}],"segments":[],"breakdowns":[],"unmatched_intents":[]}' ELSE '' END ||
    CASE WHEN example_id % 40 = 3 THEN ',{"step_id":"step_3","sub_question":"third step","measures":[]}' ELSE '' END ||
    ']' END || '}' AS output_json
FROM (
  SELECT event_id AS example_id, event_type,
    CASE event_id % 5 WHEN 0 THEN 'Count' WHEN 1 THEN 'Average' WHEN 2 THEN 'Max' WHEN 3 THEN 'Min' ELSE 'Sum' END AS calc,
    CASE event_id % 4 WHEN 0 THEN 'Geographic' WHEN 1 THEN 'Temporal' WHEN 2 THEN 'Entity' ELSE 'Categorical' END AS dim,
    CASE WHEN event_id % 60 = 59 THEN 'List all premium customers ordered by age' ELSE
    CASE event_id % 12
      WHEN 0 THEN 'How many of the departments closed their ledger before week ' || CAST(event_id % 90 AS STRING) || ' ?'
      WHEN 1 THEN 'List the depot, colour and mileage of each van kept by departments, lot ' || CAST(user_id AS STRING)
      WHEN 2 THEN 'What are the slowest lifts in departments on a tight budget after a ' || event_type || '?'
      WHEN 3 THEN 'Compare umbrella sales in Q1 2024 with the rain in Q2 2024 for top ' || CAST(event_id % 9 + 1 AS STRING) || ' companies'
      WHEN 4 THEN 'Find how yearly student enrollment follows bus fares at schools of one affiliation type'
      WHEN 5 THEN 'Show which industry those companies left after ' || event_type || ' events'
      WHEN 6 THEN 'how many ' || event_type || 's'
      WHEN 7 THEN 'List dogs ' || CAST(event_id % 7 AS STRING)
      WHEN 8 THEN 'What are zebras'
      WHEN 9 THEN 'Which films have the highest percentage of ' || event_type || 's versus books?'
      WHEN 10 THEN 'Return the smallest price change seen by user ' || CAST(user_id AS STRING)
      ELSE 'Show the average tonnage of ships and the trend by country'
    END END AS input
  FROM @events
) b
"""

# Outputs as other writers spell them: own key order, white space, long and spelled numbers, escapes,
# repeated keys, elements of other kinds, texts that are no object. ``~`` stands for a backslash.
ODD_SQL = """
SELECT 1000000000 + event_id AS example_id, 'Show sales of departments in Q' || CAST(event_id % 4 + 1 AS STRING) || ' 2024' AS input,
  replace(replace(CASE event_id % 9
    WHEN 0 THEN '{ "version" : 123456789012345678901234567890123456789012 , "discovery_results" : [ {"measures":[ {"n":1.0,"calculation":"Count","name":"Count"} , 7, "a {~"name~":~"Count~"}" ],"weight":1e5,"sub_question":"x","step_id":"step_1"} , "stray" ], "intent":"a" }'
    WHEN 1 THEN '{"discovery_results":[{"measures":[{"name":"Max"}]}],"intent":"i","discovery_results":[{"measures":[{"name":"Max"}],"dimensions":[{"name":"Temporal","name":"Geographic"}],"measures":[{"name":"Sum","name":"Min","share":0.10}]}]}'
    WHEN 2 THEN '{"discovery_results":[{"measure~u0073":[{"na~u006de":"~u0043ount","calculation":"Count"}],"unmatched_intents":[{"type":"act~u0069on","phrase":"sal~u0065s"},{"type":"action"},[{"type":"action"}]],"sub_question":null}]}'
    WHEN 3 THEN '{}'
    WHEN 4 THEN '{"discovery_results":{"measures":[{"name":"Max"}]},"note":"caf@"}'
    WHEN 5 THEN '{"intent":"i","discovery_results":[ {  } , {"dimensions":[ ],"measures":null,"unmatched_intents":{"type":"action"}} ],"extra":{"discovery_results":[{"measures":[{"name":"Max"}]}]}}'
    WHEN 6 THEN '{"intent":"i","discovery_results":[{"step_id":1,"dimensions":[{"name":"Categorical","filter":{"name":"Temporal"},"list":[{"name":"Geographic"}]}],"sub_question":{"text":"x","alt":[1, 2]} ,"unmatched_intents":[{"type":"action","phrase":"schools","phrase":"budget"}]}]}'
    WHEN 7 THEN '{"intent":"i","discovery_results":[{"measures":[{"name":"Max"}]}]'
    ELSE '[{"measures":[{"name":"Max"}]}]' END, '~', chr(92)), '@', chr(233)) AS output_json
FROM @events WHERE event_id % 25 < 9
"""

# Examples as JSON Lines, some lines no records. Questions hold no character that JSON would escape.
LINES_SQL = """
SELECT example_id, CASE example_id % 50
    WHEN 7 THEN 'no record ' || CAST(example_id AS STRING)
    WHEN 8 THEN '{"output":' || output_json || '}'
    WHEN 9 THEN '{"input":"' || input || '"}'
    WHEN 10 THEN '{"input":"' || input || '","output":[' || CAST(example_id AS STRING) || ']}'
    WHEN 11 THEN '  '
    ELSE '{ "output" : ' || output_json || ', "id":' || CAST(example_id AS STRING) || ',"input":"' || input || '"}' END AS line
FROM @examples
"""

EXISTING_SQL = """
SELECT c_custkey AS line_no,
  CASE WHEN c_custkey % 15 = 0 THEN '   '
       WHEN c_custkey % 10 = 0 THEN '  // ' || c_mktsegment || ' questions'
       ELSE CAST(c_custkey AS STRING) || '. What is the revenue for ' || c_name || '? ' END AS line
FROM @customer
"""

GENERATED_SQL = """
SELECT p_partkey AS line_no,
  CASE WHEN p_partkey % 15 = 0 THEN ''
       WHEN p_partkey % 10 = 0 THEN '// ' || p_type
       WHEN p_partkey % 4 = 1 THEN 'Show the trend of ' || p_name || ' by 2. quarter'
       ELSE ' ' || CAST(p_partkey + 1 AS STRING) || '.   List the top 5 buyers of ' || p_name END AS line
FROM @part
"""

# ``attempts`` holds event_id and attempt 0, 1, 2.
RESPONSES_SQL = """
SELECT event_id AS example_id, attempt,
  CASE WHEN event_id % 10 = 9 THEN NULL
       WHEN event_id % 10 = 8 THEN '{"intent": "intents_disc'
       WHEN event_id % 10 = 7 AND attempt = 0 THEN 'not json'
       WHEN event_id % 10 = 6 AND attempt = 0 THEN NULL
       WHEN event_id % 10 = 5 THEN CASE WHEN attempt < 2 THEN '{' ELSE NULL END
       WHEN event_id % 10 = 4 THEN CASE WHEN attempt < 2 THEN NULL ELSE '[1,' END
       ELSE '{"intent":"intents_discovery","attempt":' || CAST(attempt AS STRING) || '}' END AS content,
  CASE WHEN event_id % 10 = 9 THEN 'timeout'
       WHEN event_id % 10 = 6 AND attempt = 0 THEN 'rate_limit'
       WHEN event_id % 10 = 5 AND attempt = 2 THEN 'timeout'
       WHEN event_id % 10 = 4 AND attempt < 2 THEN 'timeout'
       ELSE NULL END AS error
FROM @attempts
"""


def _run(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    for name, df in frames.items():
        view = f"pm_{name}"
        df.createOrReplaceTempView(view)
        sql = sql.replace(f"@{name}", view)
    return spark.sql(sql)


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(example_id, input, output_json)``, one per event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _run(spark, EXAMPLES_SQL, events=events)


def odd_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples, and those whose outputs are spelled otherwise."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return examples(spark, sf_dir).unionByName(_run(spark, ODD_SQL, events=events))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(example_id, line)``: the examples as lines of record files."""
    return _run(spark, LINES_SQL, examples=examples(spark, sf_dir))


def existing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, EXISTING_SQL, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def generated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, GENERATED_SQL, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(example_id, attempt, content, error)``, three attempts per event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    attempts = events.select("event_id", F.explode(F.array(*map(F.lit, range(3)))).alias("attempt"))
    return _run(spark, RESPONSES_SQL, attempts=attempts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as questions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("example_id"), F.col("text").alias("input"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversation turns as questions."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", F.col("text").alias("input"))
