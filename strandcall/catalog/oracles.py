"""The queries of ``queries.py`` in plain SQL over the stored tables."""

from __future__ import annotations

from strandcall.functions import prompts as P
from strandcall.plans import reports as R
from strandcall.vocab import CLASSES, DOWN, NONE_EXTRACTED, NONE_OTHER, UNCHANGED, UP, WHITESPACE

SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
CELL_JOIN = """from lineitem join supplier on l_suppkey = s_suppkey
     join nation on s_nationkey = n_nationkey
     join region on n_regionkey = r_regionkey"""
AUROC_HEAD = [
    R.AUROC_TITLE,
    *R.AUROC_KINDS["dif"],
    f"{R.AUROC_RUNS_LINE}3",
    R.AUROC_SHARE_LINE.format(share="20%"),
    "",
]
REPORT_ROWS = [*CLASSES, NONE_EXTRACTED]
REPORT_HEADER = " " * 28 + " precision    recall  f1-score   support"
KEYS = "sample_id, pert, gene, cell_type"
IDS = """concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar)) as sample_id,
       concat('S', cast(l_suppkey as varchar)) as pert,
       concat('P', cast(l_partkey as varchar)) as gene, r_name as cell_type"""


def text(value: str) -> str:
    """A SQL string constant; line breaks become chr(10)."""
    lines = ["'" + line.replace("'", "''") + "'" for line in value.split("\n")]
    return lines[0] if len(lines) == 1 else "concat(" + ", chr(10), ".join(lines) + ")"


def strip(expr: str) -> str:
    return f"trim({expr}, {SPACES})"


def tag(expr: str, name: str) -> str:
    return strip(f"regexp_extract_all({expr}, '(?is)<{name}>(.*?)</{name}>', 1)[1]")


def first_class(expr: str) -> str:
    whens = " ".join(f"when contains({expr}, '{c}') then '{c}'" for c in CLASSES)
    return f"case {whens} end"


def render(template: str, **values: str) -> str:
    pieces = []
    for literal, field in P.parts(template):
        if literal:
            pieces.append(text(literal))
        if field is not None:
            pieces.append(values[field])
    return "(" + " || ".join(pieces) + ")"


def order_hash(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', " + ", ".join(f"cast({k} as varchar)" for k in keys) + "))"


def pct(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then round(100.0::double * {part} / {whole}, 6) else 0.0::double end"


def two_decimals(part: str, whole: str) -> str:
    cents = f"(({part}) * 20000 + ({whole})) // (({whole}) * 2)"
    filled = f"concat(cast({cents} // 100 as varchar), '.', lpad(cast({cents} % 100 as varchar), 2, '0'))"
    return f"case when {whole} > 0 then {filled} else '0.00' end"


# --- shared sub-queries ---------------------------------------------------------

QUESTION = render(P.QUESTION, pert="pert", gene="gene", cell_type="cell_type")

SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "de": (
        (),
        f"""select {IDS}, case when l_returnflag = 'N' then 0 else 1 end as label,
       case when l_linestatus = 'O' then 'train' else 'test' end as split, l_linenumber, l_quantity {CELL_JOIN}""",
    ),
    "dir": (
        (),
        f"""select {IDS}, case when l_returnflag = 'R' then 1 else 0 end as label {CELL_JOIN}
where l_returnflag <> 'N' and l_linenumber <> 7""",
    ),
    "excl": (("de",), "select distinct pert, gene, cell_type from de where l_quantity > 45"),
    "merged": (
        ("de", "dir"),
        """select de.sample_id, de.pert, de.gene, de.cell_type, de.split,
       case when de.label = 0 then 0 when de.label = 1 and dir.label = 0 then 1
            when de.label = 1 and dir.label = 1 then 2 else -1 end as raw
from de left join dir on de.pert is not distinct from dir.pert and de.gene is not distinct from dir.gene
     and de.cell_type = dir.cell_type""",
    ),
    "res_raw": (
        (),
        f"""select {IDS},
       case l_returnflag when 'N' then '{UNCHANGED}' when 'A' then '{DOWN}' else '{UP}' end as solution,
       case when l_discount >= 0.095 then 'no tag'
            when l_quantity <= 15 then '<think>x</think><answer>{UNCHANGED}</answer>'
            when l_returnflag = 'A' then '<think>x</think><Answer> Downregulated </Answer>'
            else '<think>x</think><answer>{UP}</answer>' end as generated_text {CELL_JOIN}""",
    ),
    "res_tag": (("res_raw",), f"select *, lower({tag('generated_text', 'answer')}) as tag from res_raw"),
    "res": (
        ("res_tag",),
        f"select {KEYS}, solution, {first_class('tag')} as extracted_answer from res_tag",
    ),
    "hit": (("res",), "select *, coalesce(extracted_answer = solution, false) as ok from res"),
    "gen_raw": (
        (),
        f"""select doc_id, cast(floor(doc_id / 32) as bigint) as batch_id, source as pert,
       concat('G', cast(doc_id % 97 as varchar)) as gene, lang as cell_type,
       case doc_id % 3 when 0 then '{UNCHANGED}' when 1 then '{DOWN}' else '{UP}' end as solution,
       case doc_id % 9
         when 0 then concat('<think>', text, '</think><answer>not differentially expressed</answer>')
         when 1 then concat('<think>', text, '</think>', chr(10), '<ANSWER>', chr(10), ' DownRegulated ', chr(9), '</ANSWER>')
         when 2 then concat('<think>', text, '</think><answer>[upregulated]</answer>')
         when 3 then concat('<think>', text, '</think><answer>downregulated, not upregulated</answer>')
         when 4 then concat('<answer>downregulated</answer>', text)
         when 5 then concat('<think>', text, '</think>')
         when 6 then concat('<think></think><answer></answer>')
         when 7 then concat('<think>', text, '</think><answer>I do not know</answer><answer>downregulated</answer>')
         else text end as generated_text
from documents""",
    ),
    "gen": (("gen_raw",), f"select *, {QUESTION} as user_prompt from gen_raw"),
    "gen_tag": (
        ("gen",),
        f"""select *, {tag('generated_text', 'think')} as thinking,
       lower({tag('generated_text', 'answer')}) as tag from gen""",
    ),
    "parsed": (
        ("gen_tag",),
        f"select *, case when thinking is not null then {first_class('tag')} end as answer from gen_tag",
    ),
    "critic": (
        (),
        """select doc_id,
       case when quality = 1 and toxic = 0 and doc_id % 2 = 0 then '<reasoning>sound</reasoning><evaluation> Excellent </evaluation>'
            when quality = 1 and toxic = 0 then '<evaluation>good</evaluation>'
            when quality = 1 then '<reasoning>weak</reasoning><evaluation>average</evaluation>'
            when toxic = 0 then '<evaluation>[bad]</evaluation>'
            else 'no tags' end as critic_text
from labels""",
    ),
    "critic_tag": (
        ("critic",),
        f"""select doc_id, critic_text, lower({tag('critic_text', 'evaluation')}) as rating_tag,
       {tag('critic_text', 'reasoning')} as critic_reasoning from critic""",
    ),
    "rated": (
        ("critic_tag",),
        """select doc_id, critic_text, critic_reasoning,
       case when rating_tag in ('excellent', 'good', 'average', 'bad', 'terrible') then rating_tag end as critic_evaluation
from critic_tag""",
    ),
    "judged": (
        ("parsed", "rated"),
        """select parsed.*, critic_text, critic_evaluation, critic_reasoning,
       coalesce(critic_evaluation in ('excellent', 'good') and answer = solution, false) as approved
from parsed left join rated on parsed.doc_id = rated.doc_id""",
    ),
    "accepted": (
        ("judged",),
        """select *, case when length(critic_reasoning) > 0 then critic_reasoning else 'N/A' end as reasoning
from judged where approved""",
    ),
    "chat": (
        (),
        """select doc_id, case when doc_id % 11 = 9 then null when doc_id % 11 = 10 then []
       else [{'role': 'system', 'content': case when doc_id % 4 = 0 then '' else concat('lang ', lang) end},
             {'role': case when doc_id % 5 = 0 then 'tool' else 'user' end, 'content': text},
             {'role': case when doc_id % 3 = 0 then 'user' else 'assistant' end,
              'content': case when doc_id % 7 <> 0 then source else '' end}] end as prompt
from documents""",
    ),
    "valid": (("chat",), "select * from chat where prompt is not null and len(prompt) > 0"),
    "lists": (
        ("dir",),
        """select pert, cell_type,
       list_sort(coalesce(list(distinct gene) filter (where label = 1), [])) as up,
       list_sort(coalesce(list(distinct gene) filter (where label = 0), [])) as down
from dir group by pert, cell_type""",
    ),
    "payload": (
        ("lists",),
        """select *, concat('Upregulated: [', array_to_string(list_transform(up, lambda g: concat('''', g, '''')), ', '), ']',
       chr(10), 'Downregulated: [', array_to_string(list_transform(down, lambda g: concat('''', g, '''')), ', '), ']') as body
from lists""",
    ),
    "conf": (
        ("res",),
        f"""select solution, coalesce(extracted_answer, '{NONE_EXTRACTED}') as predicted, count(*) as n
from res group by all""",
    ),
    "classes": (
        ("conf",),
        "select unnest(["
        + ", ".join(f"'{c}'" for c in (*CLASSES, NONE_EXTRACTED))
        + "]) as label",
    ),
    "tallies": (
        ("classes", "conf"),
        """select label,
       cast(coalesce((select sum(n) from conf where solution = label and predicted = label), 0) as bigint) as tp,
       cast(coalesce((select sum(n) from conf where solution = label), 0) as bigint) as support,
       cast(coalesce((select sum(n) from conf where predicted = label), 0) as bigint) as called
from classes""",
    ),
    "class_scores": (
        ("tallies",),
        """select label, tp, support,
       case when called > 0 then tp::double / called else 0 end as precision,
       case when support > 0 then tp::double / support else 0 end as recall,
       case when support + called > 0 then 2.0::double * tp / (support + called) else 0 end as f1
from tallies""",
    ),
    "levels": (
        ("hit",),
        f"""select case when grouping(cell_type) = 1 and grouping(pert) = 1 then 'overall'
            when grouping(cell_type) = 0 then 'cell_type' else 'pert' end as level,
       coalesce(cell_type, pert) as group_key,
       cast(count(*) filter (where ok) as bigint) as correct, cast(count(*) as bigint) as evaluated,
       {pct('count(*) filter (where ok)', 'count(*)')} as accuracy_pct
from hit group by grouping sets ((), (cell_type), (pert))""",
    ),
    "dist": (
        ("res",),
        f"""select answer, cast(count(r.sample_id) as bigint) as n, (select count(*) from res) as evaluated
from (select unnest(['{UP}', '{DOWN}', '{UNCHANGED}', '{NONE_OTHER}']) as answer) a
left join (select sample_id, coalesce(extracted_answer, '{NONE_OTHER}') as answer from res) r using (answer)
group by answer""",
    ),
}


def sql(body: str, *names: str) -> str:
    """A query with the shared sub-queries it needs in front."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in SHARED[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    ctes = ",\n".join(f"{name} as ({SHARED[name][1]})" for name in ordered)
    return f"with {ctes}\n{body}" if ctes else body


def auroc(rows: str, by: str = "") -> str:
    """Rank-sum AUROC of ``rows`` (columns y, score and the groups)."""
    group = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    tail = f" group by {by}" if by else ""
    return f"""select {group}case when sum(p) > 0 and sum(n) > 0
       then round(sum(p::double * (below + n / 2.0::double)) / (sum(p)::double * sum(n)::double), 6) end as auroc,
       cast(coalesce(sum(p), 0) as bigint) as positives, cast(coalesce(sum(n), 0) as bigint) as negatives
from (select *, coalesce(sum(n) over ({part} order by score rows between unbounded preceding and 1 preceding), 0) as below
      from (select {group}score, count(*) filter (where y = 1) as p, count(*) filter (where y = 0) as n
            from ({rows}) group by {group}score)){tail}"""


def scored(source: str, stage: str, extra: str = "") -> str:
    if stage == "dif":
        y = f"case when solution in ('{UP}', '{DOWN}') then 1 when solution = '{UNCHANGED}' then 0 else -1 end"
        s = f"case when extracted_answer in ('{UP}', '{DOWN}') then 1.0::double when extracted_answer = '{UNCHANGED}' then 0.0::double else 0.5::double end"
    else:
        y = f"case when solution = '{UP}' then 1 when solution = '{DOWN}' then 0 else -1 end"
        s = f"case when extracted_answer = '{UP}' then 1.0::double when extracted_answer = '{DOWN}' then 0.0::double else 0.5::double end"
    return f"select * from (select {extra}{y} as y, {s} as score from {source}) where y <> -1"


def runs_of(stage_filter: str = "") -> str:
    """Three samples of a fifth of the results, with their run."""
    h = order_hash(88, "run", "sample_id", "pert", "gene", "cell_type")
    return f"""(select * from (select *, row_number() over (partition by run order by {h}, {KEYS}) as rn
 from res, (select unnest([1, 2, 3]) as run)) where rn <= (select floor(count(*) * 0.2::double) from res){stage_filter})"""


def lowest(source: str, columns: str, seed: int, fraction: float, minimum: int = 0) -> str:
    h = order_hash(seed, "sample_id", "pert", "gene", "cell_type")
    return f"""(select {columns} from (select *, row_number() over (order by {h}, {KEYS}) as rn from {source})
where rn <= (select greatest(floor(count(*) * {fraction}::double), {minimum}) from {source}))"""


def lowest_numbered(seed: int, wanted: str, columns: str) -> str:
    """Rows numbered within their keys, in hash order, with their rank and how many are wanted."""
    keys = ("pert", "gene", "cell_type", "occurrence")
    numbered = """(select pert, gene, cell_type,
       cast(row_number() over (partition by pert, gene, cell_type) - 1 as bigint) as occurrence from de)"""
    return f"""select pert, gene, cell_type, occurrence{columns} from (select *, {wanted} as wanted,
       row_number() over (order by {order_hash(seed, *keys)}, {", ".join(keys)}) as rn from {numbered})"""


def scores_of_runs(by: str) -> str:
    """AUROC of runs drawn by the sample keys and the occurrence, which is 0 as they identify rows."""
    h = order_hash(88, "run", "sample_id", "pert", "gene", "cell_type", "0")
    drawn = f"""(select * from (select *, row_number() over (partition by run order by {h}, {KEYS}) as rn
 from res, (select unnest([1, 2, 3]) as run)) where rn <= (select floor(count(*) * 0.2::double) from res))"""
    return auroc(scored(drawn, "dif", "run, cell_type, "), by)


def gaps(source: str) -> str:
    return f"""(select * replace (case when right(gene, 1) <> '3' then pert end as pert,
       case when right(gene, 1) not in ('8', '9') then gene end as gene) from {source})"""


FAILING = """(select *, coalesce(answer = solution, false) as ok from (select *, sample_id like '%7' as bad,
       case when sample_id not like '%7' then extracted_answer end as answer from res))"""


def strings(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


FIRST_USER = "list_filter(prompt, lambda m: m.role = 'user' and length(m.content) > 0)[1].content"
USABLE = "list_filter(prompt, lambda m: m.role in ('system', 'user', 'assistant') and length(m.content) > 0)"
USERS = "list_filter(prompt, lambda m: m.role = 'user')"


def chat_text(style: str) -> str:
    if style == "blocks":
        item = "concat('[', upper(m.role), ']', chr(10), m.content, chr(10), chr(10))"
        return f"array_to_string(list_transform(prompt, lambda m: {item}), '')"
    if style == "joined":
        return "array_to_string(list_transform(prompt, lambda m: m.content), ' ')"
    item = "concat('<|', m.role, '|>', chr(10), m.content)"
    return f"array_to_string(list_transform(prompt, lambda m: {item}), chr(10))"


def sft(system: str, reply: str) -> str:
    return f"""concat('<|system|>', chr(10), {text(system)}, chr(10), '<|user|>', chr(10), user_prompt, chr(10),
       '<|assistant|>', chr(10), {reply})"""


def list_body(key: str) -> str:
    return f"regexp_extract_all(tag, '{key}:\\s*(\\[.*?\\])', 1)[1]"


def list_items(body: str) -> str:
    return f"array_to_string(regexp_extract_all({body}, '''([^'']*)''', 1), ',')"


MODES = [*P.SYSTEM_TEMPLATES, "no such mode"]


def prompt_of(template: str) -> str:
    return render(template, pert="pert", gene="gene", cell_type="cell_type", answer="solution")


def by_mode(prompt) -> str:
    return "case mode " + " ".join(f"when '{m}' then {prompt_of(prompt(m))}" for m in P.SYSTEM_TEMPLATES) + " end"


def modes(names, prompt) -> str:
    return " union all ".join(f"select doc_id, '{m}' as mode, {prompt(m)} as prompt from gen" for m in names)


INDEXED = f"row_number() over (order by {order_hash(88, 'sample_id', 'pert', 'gene', 'cell_type')}, {KEYS}) - 1"
TEST_CELLS = "lower(cell_type) in ('asia', 'europe')"

ORACLES: dict[str, str] = {
    # splits
    "split_filter": sql(f"select {KEYS}, label from de where split = 'test'", "de"),
    "holdout_train": sql(f"select {KEYS}, label from de where not {TEST_CELLS}", "de"),
    "holdout_test": sql(f"select {KEYS}, label from de where {TEST_CELLS}", "de"),
    "holdout_cells": sql(
        f"""select distinct lower(cell_type) as cell_line,
       case when {TEST_CELLS} then 'test' else 'train' end as part from de""",
        "de",
    ),
    "union_cells": sql(
        f"""select cell_type, split, cast(count(*) as bigint) as n from
(select cell_type, split from de where not {TEST_CELLS} union all select cell_type, null from de where {TEST_CELLS})
group by all""",
        "de",
    ),
    "valid_prompts": sql("select doc_id, cast(len(prompt) as integer) as n_messages from valid", "valid"),
    # labels
    "ternary_labels": sql(
        """select cell_type, case when raw = -1 then 0 else raw end as label, cast(count(*) as bigint) as n
from merged where split = 'test' group by all""",
        "merged",
    ),
    "label_quality": sql(
        """select cell_type, cast(count(*) as bigint) as n_samples,
       cast(count(*) filter (where raw = -1) as bigint) as n_repaired from merged group by cell_type""",
        "merged",
    ),
    "labelled_samples": sql(
        f"""select {KEYS}, case when raw = -1 then 0 else raw end as label,
       case raw when 1 then '{DOWN}' when 2 then '{UP}' else '{UNCHANGED}' end as solution from merged""",
        "merged",
    ),
    "label_validity": sql(
        """select case when good then cast(cast(number as integer) as varchar) else label end as label,
       case when good then 'kept' when number is null then 'not a number' else 'not 0 or 1' end as reason,
       cast(count(*) as bigint) as n
from (select *, coalesce(number in (0, 1), false) as good from
      (select *, try_cast(label as double) as number from
       (select case l_linenumber when 1 then '1' when 2 then '0' when 3 then '1.0' when 4 then 'x' when 5 then '2'
                    when 7 then '0.0' end as label from de)))
group by all""",
        "de",
    ),
    "label_truncation": sql(
        """select case when good then cast(cast(trunc(number) as integer) as varchar) else label end as label,
       case when good then 'kept' when number is null then 'not a number' else 'not 0 or 1' end as reason,
       cast(count(*) as bigint) as n
from (select *, coalesce(trunc(number) in (0, 1), false) as good from
      (select *, try_cast(label as double) as number from
       (select case l_linenumber when 1 then '1' when 2 then '0' when 3 then '1.0' when 4 then 'x' when 5 then '1.5'
                    when 7 then '0.7' end as label from de)))
group by all""",
        "de",
    ),
    "label_words": sql(
        "select pert, gene, cell_type, case label when 0 then 'down' when 1 then 'up' end as direction from dir", "dir"
    ),
    "trinary_scores": sql(
        f"""select case solution when '{UP}' then 1 when '{DOWN}' then 0 when '{UNCHANGED}' then 2 else -1 end as y,
       case extracted_answer when '{UP}' then 1.0::double when '{DOWN}' then 0.0::double
            when '{UNCHANGED}' then 2.0::double else 0.5::double end as score,
       cast(count(*) as bigint) as n from res group by all""",
        "res",
    ),
    "exclude_used": sql(
        f"""select {KEYS}, label from de where not exists (select 1 from excl where excl.pert = de.pert
and excl.gene = de.gene and excl.cell_type = de.cell_type)""",
        "excl",
    ),
    "excluded_counts": sql(
        """select cell_type, cast(count(*) as bigint) as n_excluded from de join excl using (pert, gene, cell_type)
group by cell_type""",
        "excl",
    ),
    "load_report": sql(
        """select cell_type, cast(sum(b) as bigint) as rows_before, cast(sum(a) as bigint) as rows_after,
       cast(sum(s) as bigint) as samples, cast(sum(x) as bigint) as excluded, cast(sum(s - x) as bigint) as kept,
       cast(count(*) filter (where s > x) as bigint) as cell_lines
from (select cell_type, (select count(*) from de d where d.cell_type = c.cell_type) as b,
             (select count(*) from de d where d.cell_type = c.cell_type and split = 'train') as a,
             (select count(*) from merged m where m.cell_type = c.cell_type and split = 'train') as s,
             (select count(*) from merged m join excl e on m.pert = e.pert and m.gene = e.gene and m.cell_type = e.cell_type
              where m.cell_type = c.cell_type and split = 'train') as x
      from (select distinct cell_type from de) c)
group by rollup (cell_type)""",
        "merged",
        "excl",
    ),
    # lists
    "gene_lists": sql(
        """select pert, cell_type, array_to_string(up, ',') as upregulated, array_to_string(down, ',') as downregulated
from lists""",
        "lists",
    ),
    "genes_by_pert": sql(
        f"""select pert, page, cast(count(*) as bigint) as n_genes, string_agg(gene, ',' order by gene) as genes
from (select pert, gene, cast((row_number() over (partition by pert order by {order_hash(0, 'gene')}, gene) - 1) // 100 as bigint) as page
      from de) group by pert, page""",
        "de",
    ),
    "list_solution": sql(
        "select pert, cell_type, concat('<answer>', body, '</answer>') as solution_text from payload", "payload"
    ),
    "list_prompts": sql(
        f"""select pert, cell_type, {render(P.list_template('synth_data_with_ans'), pert='pert', payload='body')} as system_prompt,
       {render(P.LIST_QUESTION, pert='pert', cell_type='cell_type')} as user_prompt from payload""",
        "payload",
    ),
    "extract_gene_lists": f"""select doc_id, tag is not null as readable,
       case when tag is not null then coalesce({list_items('up')}, '') end as upregulated,
       case when tag is not null then coalesce({list_items('down')}, '') end as downregulated
from (select doc_id, tag, {list_body('Upregulated')} as up, {list_body('Downregulated')} as down
      from (select doc_id, {tag('generated_text', 'answer')} as tag from
       (select doc_id,
       case doc_id % 5
         when 0 then concat('<answer>Upregulated: [''A', cast(doc_id % 7 as varchar), ''', ''B'']; Downregulated: [''C'']</answer>')
         when 1 then concat('<answer>Upregulated: []', chr(10), 'Downregulated: [''D'', ''E'']</answer>')
         when 2 then '<answer>Upregulated: [''F'']</answer>'
         when 3 then '<answer>upregulated: [''lower case key'']</answer>'
         else 'none' end as generated_text
from documents)))""",
    "gene_list_holdout": sql(
        """select 'train' as split, pert, cell_type, cast(len(up) as integer) as n_up, cast(len(down) as integer) as n_down
from lists""",
        "lists",
    ),
    "gene_list_answers": sql(
        "select pert, cell_type, cell_type = 'ASIA' or up = down as is_correct from lists", "lists"
    ),
    # parsing
    "extract_answer": sql(f"select doc_id, {first_class('tag')} as extracted_answer from gen_tag", "gen_tag"),
    "extract_think_answer": sql(
        "select doc_id, thinking as generated_thinking, answer as generated_answer from parsed", "parsed"
    ),
    "critic_ratings": sql("select doc_id, critic_evaluation, critic_reasoning from rated", "rated"),
    # prompts and messages
    "system_prompts": sql(
        modes(
            P.SYSTEM_TEMPLATES,
            lambda m: render(P.system_template(m, True), pert="pert", gene="gene", answer="solution"),
        ),
        "gen",
    ),
    "user_prompts": sql(
        modes(
            ("default", "direction_test_prompt", "o3_direction_test"),
            lambda m: render(P.user_template(m), pert="pert", gene="gene", cell_type="cell_type"),
        ),
        "gen",
    ),
    "critic_prompts": sql(
        f"""select doc_id, concat('[SYSTEM]', chr(10), {text(P.critic_template(True))}, chr(10), chr(10), '[USER]', chr(10),
       {render(P.CRITIC_USER, user_query='user_prompt', thinking='thinking')}, chr(10), chr(10)) as prompt
from parsed where thinking is not null""",
        "parsed",
    ),
    "context_prompts": sql(
        f"""select {KEYS}, {QUESTION} || coalesce({render(P.CONTEXT_LEAD, context='context')}, '') as prompt
from de left join (select concat('S', cast(s_suppkey as varchar)) as pert, s_name as context from supplier
                   where s_acctbal > 0) c using (pert)""",
        "de",
    ),
    "context_prompts_by_key": sql(
        f"""select {KEYS}, {QUESTION} || coalesce({render(P.CONTEXT_LEAD, context='context')}, '') as prompt
from de left join (select pert, gene, cell_type, concat('used ', cast(count(*) as varchar), ' times') as context
                   from de where l_quantity > 45 group by pert, gene, cell_type) c using (pert, gene, cell_type)""",
        "de",
    ),
    "single_file_prompts": sql(
        f"""select pert, gene, label, case label when 0 then 'down' else 'up' end as solution,
       {text(P.UP_DOWN_SYSTEM)} || ' ' || {render(P.QUESTION, pert='pert', gene='gene', cell_type="'rpe1'")}
       || coalesce({render(P.CONTEXT_LEAD, context='context')}, '') as chat
from (select pert, gene, case l_linenumber when 1 then 1 when 2 then 0 when 3 then 1 when 7 then 0 end as label from de
      where l_linenumber in (1, 2, 3, 7)) d
left join (select concat('S', cast(s_suppkey as varchar)) as pert, s_name as context from supplier
           where s_acctbal > 0) c using (pert)""",
        "de",
    ),
    "first_user_message": sql(
        f"select doc_id, cast(len({USABLE}) as integer) as n_usable, {FIRST_USER} as user_query from valid", "valid"
    ),
    "last_user_message": sql(
        f"""select doc_id, concat(left(case when len({USERS}) > 0 then {USERS}[-1].content else 'API_CALL_FAILED' end, 200),
       '... (API Call Failed)') as failed_prompt,
       case when len(prompt) > 1 then coalesce(prompt[-1].content, '') else '' end as last_content from valid""",
        "valid",
    ),
    "generation_prompts": sql(
        f"select doc_id, concat({chat_text('tags')}, chr(10), '<|assistant|>', chr(10)) as chat from valid", "valid"
    ),
    "render_chat": sql(
        " union all ".join(
            f"select doc_id, '{style}' as style, {chat_text(style)} as chat from valid"
            for style in ("blocks", "joined", "tags")
        ),
        "valid",
    ),
    "chat_opening": """select conv_id, min_by(text, turn) as first_user, max_by(text, turn) as last_user,
       cast(count(*) as bigint) as user_turns
from conversations where role = 'user' and length(text) > 0 group by conv_id""",
    # curation
    "critic_join": sql(
        """select gen.doc_id, pert, gene, cell_type, critic_text from gen left join critic on gen.doc_id = critic.doc_id""",
        "gen",
        "critic",
    ),
    "failed_batches": sql(
        f"""select doc_id, batch_id, bad as api_error, case when not bad then x end as extracted_answer,
       not bad and coalesce(x = solution, false) as is_correct,
       case when bad then concat(left(user_prompt, 200), '... (API Call Failed)') end as failed_prompt
from (select g.*, {first_class('g.tag')} as x,
             max(case when c.critic_text = 'no tags' then 1 else 0 end) over (partition by batch_id) = 1 as bad
      from gen_tag g left join critic c on g.doc_id = c.doc_id)""",
        "gen_tag",
        "critic",
    ),
    "result_records": sql(
        f"""select case when bad then concat(left(user_prompt, 200), '... (API Call Failed)') else user_prompt end as user_prompt,
       pert, gene, cell_type, case when bad then 'Error: call failed' else generated_text end as generated_text,
       case when not bad then x end as extracted_answer, solution as correct_solution,
       not bad and coalesce(x = solution, false) as is_correct, bad as api_error
from (select g.*, {first_class('g.tag')} as x,
             max(case when c.critic_text = 'no tags' then 1 else 0 end) over (partition by batch_id) = 1 as bad
      from gen_tag g left join critic c on g.doc_id = c.doc_id)""",
        "gen_tag",
        "critic",
    ),
    "accepted_examples": sql(
        """select doc_id, pert, gene, cell_type, solution as true_answer, user_prompt, generated_text as assistant_response,
       thinking as generated_thinking, answer as generated_answer, critic_evaluation, reasoning as critic_reasoning
from accepted""",
        "accepted",
    ),
    "approval_summary": sql(
        f"""select cast(count(*) as bigint) as processed, cast(count(*) filter (where approved) as bigint) as approved,
       {pct('count(*) filter (where approved)', 'count(*)')} as approval_pct from judged""",
        "judged",
    ),
    "rejection_funnel": sql(
        f"""select case when {FIRST_USER} is null then 'no user query' when generated_text is null then 'generator failed'
       when thinking is null then 'no think block' when critic_text is null then 'critic failed'
       when critic_evaluation is null then 'rating unreadable'
       when critic_evaluation not in ('excellent', 'good') then 'rating below threshold'
       when answer is null then 'answer unparsed' when answer <> solution then 'answer wrong' else 'accepted' end as reason,
       cast(count(*) as bigint) as n
from judged join chat using (doc_id) group by all""",
        "judged",
        "chat",
    ),
    "sft_text_cot": sql(
        f"select doc_id, {sft(P.SFT_SYSTEM['dif'], 'generated_text')} as text from accepted", "accepted"
    ),
    "sft_text_direct": sql(
        f"""select doc_id, {sft(P.SFT_SYSTEM['dir'], "concat('<answer>', solution, '</answer>')")} as text from accepted""",
        "accepted",
    ),
    # metrics
    "accuracy_overall": sql(
        f"""select cast(count(*) filter (where ok) as bigint) as correct, cast(count(*) as bigint) as evaluated,
       {pct('count(*) filter (where ok)', 'count(*)')} as accuracy_pct from hit""",
        "hit",
    ),
    **{
        f"accuracy_by_{short}": sql(
            f"""select {column}, cast(count(*) filter (where ok) as bigint) as correct, cast(count(*) as bigint) as evaluated,
       {pct('count(*) filter (where ok)', 'count(*)')} as accuracy_pct from hit group by {column}""",
            "hit",
        )
        for short, column in (("cell", "cell_type"), ("pert", "pert"))
    },
    "accuracy_rollup": sql("select * from levels", "levels"),
    "prediction_distribution": sql(f"select answer, n, evaluated, {pct('n', 'evaluated')} as pct from dist", "dist"),
    "confusion_matrix": sql("select solution, predicted, cast(n as bigint) as n from conf", "conf"),
    "class_report": sql(
        """select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support
from class_scores""",
        "class_scores",
    ),
    "class_report_averages": sql(
        """select 'accuracy' as label, round(sum(tp)::double / sum(support), 6) as precision,
       round(sum(tp)::double / sum(support), 6) as recall, round(sum(tp)::double / sum(support), 6) as f1,
       cast(sum(support) as bigint) as support from class_scores
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       cast(sum(support) as bigint) from class_scores
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from class_scores""",
        "class_scores",
    ),
    "report_lines": sql(
        f"""select 1 as section, unnest(['1', '2', '3', '4']) as position,
       unnest(['--- Overall Evaluation Summary ---', concat('Total Samples Evaluated: ', evaluated),
               concat('Correct Predictions: ', correct),
               concat('Overall Accuracy: ', {two_decimals('correct', 'evaluated')}, '%')]) as line
from levels where level = 'overall'
union all select unnest([2, 3, 4]), '', unnest(['--- Predicted Answer Distribution (Model Output) ---',
       '--- Accuracy by Cell Type ---', '--- Accuracy by Perturbation ---'])
union all select 2, answer, concat('  Predicted as ''', answer, ''': ', n, ' times (', {two_decimals('n', 'evaluated')}, '%)') from dist
union all select case when level = 'cell_type' then 3 else 4 end, group_key,
       concat('  ', group_key, ': ', {two_decimals('correct', 'evaluated')}, '% (', correct, '/', evaluated, ')')
from levels where level <> 'overall'""",
        "levels",
        "dist",
    ),
    "auroc_dif": sql(auroc(scored("res", "dif")), "res"),
    "auroc_dir": sql(auroc(scored("res", "dir")), "res"),
    "auroc_by_cell": sql(auroc(scored("res", "dif", "cell_type, "), "cell_type"), "res"),
    "auroc_narrow": auroc(
        """select l_linestatus as cell_type, case when l_returnflag = 'R' then 1 else 0 end as y,
       5000.0::double + cast((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000003 as double) / 1000003.0::double as score
from lineitem where l_returnflag <> 'N'""",
        "cell_type",
    ),
    "auroc_runs": sql(
        auroc(scored(runs_of(f" and solution in ('{UP}', '{DOWN}')"), "dir", "run, "), "run"), "res"
    ),
    "auroc_text": sql(
        f"""select 1 as section, cast(k - 1 as varchar) as position, head[k] as line
from (select {strings(AUROC_HEAD)} as head, unnest([1, 2, 3, 4, 5, 6]) as k)
union all select 2, '0', case when v > 0 then printf('Mean Overall AUROC across runs: %.4f (Std: %.4f, Valid Runs: %d/3)', m, s, v)
       else {text(R.NO_AUROC)} end
from (select avg(auroc) as m, stddev_pop(auroc) as s, count(auroc) as v from ({scores_of_runs('run')}))
union all select 2, '1', concat({text(R.AUROC_EACH)}, string_agg(concat(chr(39), coalesce(printf('%.4f', auroc), 'N/A'), chr(39)), ', ' order by run), ']')
from ({scores_of_runs('run')}) having count(auroc) > 0
union all select 3, unnest(['0', '1']), unnest(['', {text(R.AUROC_CELLS_TITLE)}])
union all select 4, cell_type, case when count(auroc) > 0 then
       printf('  %s: %.4f (Std: %.4f, Valid Runs: %d/3)', cell_type, avg(auroc), stddev_pop(auroc), count(auroc))
       else concat('  ', cell_type, ': Not calculable or no valid scores in any run.') end
from ({scores_of_runs('run, cell_type')}) group by cell_type
union all select 5, unnest(['0', '1']), unnest(['', {text(R.AUROC_END)}])""",
        "res",
    ),
    "class_report_text": sql(
        f"""select 1 as section, position, line from (
select 'a' as position, {text(REPORT_HEADER)} as line
union all select unnest(['a1', 'b09']), ''
union all select concat('b0', list_position({strings(REPORT_ROWS)}, label) - 1),
       concat(lpad(label, 28, ' '), printf(' %9.2f %9.2f %9.2f %9d', precision, recall, f1, support)) from class_scores
union all select 'b10', concat(lpad('accuracy', 28, ' '), repeat(' ', 20),
       printf(' %9.2f %9d', sum(tp)::double / sum(support), cast(sum(support) as bigint))) from class_scores
union all select 'b11', concat(lpad('macro avg', 28, ' '),
       printf(' %9.2f %9.2f %9.2f %9d', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint))) from class_scores
union all select 'b12', concat(lpad('weighted avg', 28, ' '), printf(' %9.2f %9.2f %9.2f %9d', sum(precision * support) / sum(support),
       sum(recall * support) / sum(support), sum(f1 * support) / sum(support), cast(sum(support) as bigint))) from class_scores)""",
        "class_scores",
    ),
    "auroc_summary": sql(
        f"""select cell_type, round(avg(auroc), 6) as mean_auroc, round(stddev_pop(auroc), 6) as std_auroc,
       cast(count(auroc) as bigint) as valid_runs, cast(3 as bigint) as runs
from ({auroc(scored(runs_of(), 'dif', 'run, cell_type, '), 'run, cell_type')}) group by cell_type""",
        "res",
    ),
    # samples and batches
    "sample_exact": sql(f"select * from {lowest('de', KEYS, 88, 0.15, 1)}", "de"),
    "sample_no_min": sql(f"select * from {lowest('de', KEYS, 88, 0.05)}", "de"),
    "direction_stage": sql(
        f"""select * from {lowest('res', KEYS + ', solution, extracted_answer', 88, 0.25, 1)}
where solution in ('{UP}', '{DOWN}')""",
        "res",
    ),
    "sample_duplicates": sql(
        "select pert, gene, cell_type, occurrence from ("
        + lowest_numbered(88, "(select greatest(floor(count(*) * 0.15::double), 1) from de)", ", rn, wanted")
        + ") where rn <= wanted",
        "de",
    ),
    "sample_hot_key": sql(
        f"""select pert, gene, cell_type, occurrence from (
select *, row_number() over (order by {order_hash(88, 'pert', 'occurrence')}, pert, occurrence) as place from (
select *, row_number() over (partition by pert order by gene, cell_type) - 1 as occurrence from (
select case when cast(split_part(sample_id, '-', 1) as bigint) % 2 = 0 then 'HOT' else pert end as pert, gene, cell_type from de)))
where place <= (select greatest(floor(count(*) * 0.15::double), 1) from de)""",
        "de",
    ),
    "split_duplicates": sql(
        lowest_numbered(
            42,
            "(select floor(count(*) * 0.9::double) from de)",
            ", case when rn <= wanted then 'train' else 'val' end as part",
        ),
        "de",
    ),
    "train_val_split": sql(
        f"""select {KEYS}, case when rn <= (select floor(count(*) * 0.9::double) from de) then 'train' else 'val' end as part
from (select *, row_number() over (order by {order_hash(42, 'sample_id', 'pert', 'gene', 'cell_type')}, {KEYS}) as rn from de)""",
        "de",
    ),
    "batches": sql(
        f"select *, row_index // 32 as batch_id from (select {KEYS}, {INDEXED} as row_index from de)", "de"
    ),
    "batches_drop_last": sql(
        f"""select *, row_index // 32 as batch_id
from (select doc_id, pert, row_number() over (order by {order_hash(42, 'doc_id')}, doc_id) - 1 as row_index from gen)
where row_index // 32 < (select count(*) // 32 from gen)""",
        "gen",
    ),
    "prompts_by_mode": sql(
        f"""select doc_id, mode, {by_mode(P.system_template)} as system, {by_mode(P.user_template)} as "user",
       case when mode = 'no such mode' then 'unknown prompt mode: no such mode' end as problem
from (select *, ({strings(MODES)})[doc_id % {len(MODES)} + 1] as mode from gen)""",
        "gen",
    ),
    "examples_store": sql(
        """select model, 'create' as script, split_name, pert, cast(count(*) as bigint) as n,
       cast(sum(length(generated_text)) as bigint) as response_chars
from accepted join (values ('first', 'default', 2), ('second', 'asia', 1)) v(model, split_name, step) on doc_id % step = 0
group by all""",
        "accepted",
    ),
    "shard_files": sql(f"select {KEYS}, ({INDEXED}) % 4 as shard from de", "de"),
    "shards": sql(
        f"select *, row_index % 4 as shard from (select {KEYS}, {INDEXED} as row_index from de)", "de"
    ),
    "preview": sql(f"select {KEYS}, solution, extracted_answer from res order by {KEYS} limit 10", "res"),
    # streams
    # missing keys, failed calls, single classes
    "failed_overall": sql(
        f"""select cast(count(*) filter (where ok) as bigint) as correct, cast(count(*) filter (where not bad) as bigint) as evaluated,
       {pct('count(*) filter (where ok)', 'count(*) filter (where not bad)')} as accuracy_pct from {FAILING}""",
        "res",
    ),
    "failed_rollup": sql(
        f"""select level, group_key, correct, evaluated, {pct('correct', 'evaluated')} as accuracy_pct from (
select 'overall' as level, null as group_key, cast(count(*) filter (where ok) as bigint) as correct,
       cast(count(*) filter (where not bad) as bigint) as evaluated from {FAILING}
union all select 'cell_type', cell_type, cast(count(*) filter (where ok) as bigint), cast(count(*) as bigint) from {FAILING} group by cell_type
union all select 'pert', pert, cast(count(*) filter (where ok) as bigint), cast(count(*) as bigint) from {FAILING} group by pert)""",
        "res",
    ),
    "failed_distribution": sql(
        f"""select word as answer, n, evaluated, {pct('n', 'evaluated')} as pct from (
select word, cast((select count(*) from {FAILING} where coalesce(answer, '{NONE_OTHER}') = word) as bigint) as n,
       cast((select count(*) from {FAILING} where not bad) as bigint) as evaluated
from (select unnest({strings([*CLASSES, NONE_OTHER])}) as word))""",
        "res",
    ),
    "failed_confusion": sql(
        f"""select solution, coalesce(answer, '{NONE_EXTRACTED}') as predicted, cast(count(*) as bigint) as n
from {FAILING} group by all""",
        "res",
    ),
    "missing_keys_labels": sql(
        f"""select c.cell_type, case when c.label = 0 then 0 when d.label = 0 then 1 when d.label = 1 then 2 else 0 end as label,
       cast(count(*) as bigint) as n
from {gaps('de')} c left join {gaps('dir')} d on c.pert is not distinct from d.pert
     and c.gene is not distinct from d.gene and c.cell_type = d.cell_type group by all""",
        "de",
        "dir",
    ),
    "missing_keys_excluded": sql(
        f"""select cell_type, cast(count(*) as bigint) as n_excluded
from {gaps('de')} join (select distinct pert, gene, cell_type from {gaps('(select * from de where l_quantity > 45)')})
     using (pert, gene, cell_type) group by cell_type""",
        "de",
    ),
    "missing_keys_lists": sql(
        f"""select pert, cell_type, cast(count(distinct gene) filter (where label = 1) as integer) as n_up,
       cast(count(distinct gene) filter (where label = 0) as integer) as n_down
from {gaps('dir')} where pert is not null group by pert, cell_type""",
        "dir",
    ),
    "auroc_one_class": sql(
        f"""{auroc(scored("(select * replace (case when cell_type = 'ASIA' then 'upregulated' else solution end as solution) from res)", "dir", "cell_type, "), "cell_type")}
union all by name select 'nothing' as cell_type, null::double as auroc, 0::bigint as positives, 0::bigint as negatives""",
        "res",
    ),
    # files
    "csv_calls": sql(
        """select pert, gene, label::double as label, case when cell_type <> 'EUROPE' then split end as split, cell_type
from de where cell_type <> 'AMERICA'""",
        "de",
    ),
    "csv_manifest": """select r_name as cell_type, case when r_name in ('AFRICA', 'AMERICA') then 'skipped' else 'ok' end as status,
       case r_name when 'AFRICA' then 'no direction file' when 'AMERICA' then 'call file lacks gene' end as reason from region""",
    "csv_corrupt": sql(
        """select cell_type, cast(count(*) as bigint) as n_rows, cast(count(*) filter (right(gene, 1) = '7') as bigint) as n_short,
       cast(count(*) filter (right(gene, 1) = '8') as bigint) as n_long,
       cast(count(*) filter (coalesce(right(gene, 1), '') not in ('7', '8')) as bigint) as n_kept,
       cast(count(*) filter (coalesce(right(gene, 1), '') not in ('7', '8')) as bigint) as n_labels,
       cast(sum(label) filter (coalesce(right(gene, 1), '') not in ('7', '8')) as double) as label_sum
from de where label is not null group by cell_type""",
        "de",
    ),
    "holdout_by_table": sql(
        """select cell_type, case when lower(cell_type) like '%a' then 'test' else 'train' end as part, cast(count(*) as bigint) as n
from de group by all""",
        "de",
    ),
    "csv_pairs": sql(
        """select 'de' as kind, cell_type, cast(count(*) as bigint) as n from de where cell_type in ('EUROPE', 'MIDDLE EAST') group by all
union all select 'dir', cell_type, cast(count(*) as bigint) from dir where cell_type in ('EUROPE', 'MIDDLE EAST') group by all""",
        "de",
        "dir",
    ),
    "csv_single": sql("select pert, gene, cast(label as varchar) as label from dir where cell_type = 'EUROPE'", "dir"),
    "csv_exclusions": sql("select * from excl", "excl"),
    "examples_round_trip": sql(
        """select pert, gene, cell_type, solution as true_answer, cast(count(*) as bigint) as n,
       cast(sum(length(generated_text)) as bigint) as response_chars from accepted group by all""",
        "accepted",
    ),
    "results_round_trip": sql(f"select {KEYS}, solution, extracted_answer from res", "res"),
    "empty_reason": sql(
        """select cast((select count(distinct split) from de) as bigint) as n_splits, split,
       case when exists (select 1 from de where de.split = s.split) then 'ok'
            else concat('dataset is empty: no row in split ', split) end as said
from (select unnest(['train', 'test', 'holdout']) as split) s""",
        "de",
    ),
    # streams
    "stream_approval": f"""select cast(count(*) as bigint) as processed,
       cast(count(*) filter (where event_type = 'purchase') as bigint) as approved,
       {pct("count(*) filter (where event_type = 'purchase')", 'count(*)')} as approval_pct from events""",
    "stream_results": sql("select * from levels", "levels"),
    "stream_batches": sql(
        f"""select doc_id, batch_id, bad as api_error, case when not bad then x end as extracted_answer,
       not bad and coalesce(x = solution, false) as is_correct,
       case when bad then concat(left(user_prompt, 200), '... (API Call Failed)') end as failed_prompt
from (select g.*, {first_class('g.tag')} as x,
             max(case when c.critic_text = 'no tags' then 1 else 0 end) over (partition by batch_id) = 1 as bad
      from gen_tag g left join critic c on g.doc_id = c.doc_id)""",
        "gen_tag",
        "critic",
    ),
    "stream_snapshots": sql(
        f"""select case when grouping(cell_type) = 1 and grouping(pert) = 1 then 'overall'
            when grouping(cell_type) = 0 then 'cell_type' else 'pert' end as level,
       coalesce(cell_type, pert) as group_key,
       cast(count(*) filter (where ok) as bigint) as correct, cast(count(*) as bigint) as evaluated,
       {pct('count(*) filter (where ok)', 'count(*)')} as accuracy_pct, batches
from hit join (select unnest([3, 6, 8]) as batches) b on cast(split_part(sample_id, '-', 1) as bigint) % 8 < batches
group by grouping sets ((batches), (batches, cell_type), (batches, pert))""",
        "hit",
    ),
    "stream_curation": sql(
        f"""select cast(count(*) as bigint) as processed, cast(count(*) filter (where approved) as bigint) as approved,
       {pct('count(*) filter (where approved)', 'count(*)')} as approval_pct from judged""",
        "judged",
    ),
}
