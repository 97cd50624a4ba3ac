"""Requests to a vision-language model behind an OpenAI-compatible endpoint, and its answers as a table."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t

#: Fixed values.
SYSTEM, LAYOUT, MOST_TOKENS, LAYOUT_SIDE = "You are a helpful assistant.", "\nLayout Detection:", 4096, 1036
#: Columns of a request's row and of an answer's.
ANSWERS = "doc_id long, page_idx int, idx int, answer string, error string"
Send = Callable[[str], str]


def request(model: str, image_url: Column, prompt: Column, sampling: Column, most_tokens: int = MOST_TOKENS) -> Column:
    """The JSON body of a request."""
    image = F.struct(F.lit("image_url").alias("type"), F.struct(image_url.alias("url")).alias("image_url"), F.lit(None).cast("string").alias("text"))
    words = F.struct(F.lit("text").alias("type"), F.lit(None).cast("struct<url:string>").alias("image_url"), prompt.alias("text"))
    system = F.concat(F.lit('{"role":"system","content":'), F.to_json(F.array(F.lit(SYSTEM))), F.lit("}"))
    system = F.regexp_replace(system, r'\["(.*?)"\]', '"$1"')
    user = F.concat(F.lit('{"role":"user","content":'), F.to_json(F.array(image, words)), F.lit("}"))
    names = ("temperature", "top_p", "presence_penalty", "frequency_penalty", "top_k", "repetition_penalty")
    rest = F.to_json(F.struct(*[sampling[n].alias(n) for n in names], F.lit(most_tokens).alias("max_tokens"), F.lit(False).alias("skip_special_tokens"), F.struct(sampling["no_repeat_ngram_size"].alias("no_repeat_ngram_size")).alias("vllm_xargs")))
    return F.concat(F.lit('{"model":'), F.lit(json.dumps(model)), F.lit(',"messages":['), system, F.lit(","), user, F.lit("],"), F.substring(rest, F.lit(2), F.length(rest)))


def layout_sampling() -> Column:
    f = lambda x: F.lit(x).cast("float")
    return F.struct(
        f(0.0).alias("temperature"), f(0.01).alias("top_p"), f(0.0).alias("presence_penalty"), f(0.0).alias("frequency_penalty"), F.lit(1).alias("top_k"), f(1.0).alias("repetition_penalty"),
        F.lit(100).alias("no_repeat_ngram_size"),
    )


def first_choice(response: str) -> str:
    """The first choice's text; an empty answer is a ValueError."""
    choices = json.loads(response).get("choices") or [{}]
    content = (choices[0].get("message") or {}).get("content")
    if content is None:
        raise ValueError("empty completion")
    return content


def http(url: str, seconds: float = 120.0) -> Send:
    """Sends a body to an endpoint."""

    def send(body: str) -> str:
        ask = urllib.request.Request(url.rstrip("/") + "/v1/chat/completions", body.encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(ask, timeout=seconds) as answer:
            return answer.read().decode()

    return send


def ask(requests: DataFrame, send: Send) -> DataFrame:
    """(doc_id, page_idx, idx, answer, error) from (doc_id, page_idx, idx, body). A request that fails has an error instead of an answer.

    Answers should be written before they are used: a model needn't give the same answer twice, and a lost executor would ask again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    out.append((r.doc_id, r.page_idx, r.idx, first_choice(send(r.body)), None))
                except Exception as e:  # the row carries what went wrong
                    out.append((r.doc_id, r.page_idx, r.idx, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page_idx", "idx", "answer", "error"])

    return requests.select("doc_id", "page_idx", "idx", "body").mapInPandas(run, ANSWERS)


def read_pages(pages: DataFrame, crops: Callable[[DataFrame], DataFrame], model: str, send: Send, keep: Callable[[DataFrame], DataFrame], with_images: bool = True) -> DataFrame:
    """Two steps: the layout of each page (doc_id, page_idx, width, height, image_url), then the content of each block. Gives what a VLM backend takes.

    ``crops`` gives blocks (doc_id, page_idx, idx, label, bbox) their image_url; ``keep`` writes answers and reads them again. A block whose request
    fails has no content; a page whose layout fails is an error.
    """
    from quire.operators.assemble import skips_extraction

    first = pages.withColumn("idx", F.lit(0)).withColumn("body", request(model, F.col("image_url"), F.lit(LAYOUT), layout_sampling()))
    layouts = keep(ask(first, send))
    answer = F.when(F.col("error").isNull(), F.col("answer")).otherwise(F.raise_error(F.concat(F.lit("layout request failed: "), F.col("error"))))
    read = layouts.withColumn("answer", t.strip_end_token(answer))
    blocks = read.select("doc_id", "page_idx", F.posexplode(t.layout_answer(F.col("answer"))).alias("idx", "b")).select("doc_id", "page_idx", "idx", "b.label", "b.bbox")
    wanted = crops(blocks.where(~skips_extraction(F.col("label"), with_images)))
    bodies = wanted.withColumn("body", request(model, F.col("image_url"), t.extraction_prompt(F.col("label")), t.extraction_sampling(F.col("label"))))
    contents = keep(ask(bodies, send)).groupBy("doc_id", "page_idx").agg(F.map_from_entries(F.collect_list(F.struct("idx", "answer"))).alias("m"))
    joined = pages.select("doc_id", "page_idx", "width", "height").join(read.select("doc_id", "page_idx", "answer"), ["doc_id", "page_idx"]).join(contents, ["doc_id", "page_idx"], "left")
    n = F.size(t.layout_answer(F.col("answer")))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return joined.select("doc_id", "page_idx", "width", "height", "answer", F.transform(places, lambda i: F.try_element_at(F.col("m"), i)).alias("contents"))
