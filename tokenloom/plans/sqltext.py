"""SQL text for checking: common table expressions, assembled by need.

A token is written ``<00036>``: five digits in angle brackets, so merging a
pair is ``replace``, and seven characters are one token.
"""

from __future__ import annotations

from tokenloom.functions.text import FIRST_MERGE, SPECIAL_TOKENS
from tokenloom.sources.mixes import Mix, table_mixes, tokenizer_mix

MERGES = 48
SHARD, VAL = 100_000, 10_000
PER_BATCH = 16
BATCH_SEQS, SEQ_LEN = 8, 128

# The pattern of functions.text for an engine without possessive quantifiers
# and look-ahead; it differs only for runs of white space before a word.
SPLIT = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+"
).replace("'", "''")

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str, materialized: bool = False) -> None:
    _CTES[name] = (needs, ("MATERIALIZED " if materialized else "") + f"({body})")


def sql(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in _CTES[name][0]:
            visit(need)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS {_CTES[n][1]}" for n in order) + "\n" + final


def before(column: str, over: str) -> str:
    """Exclusive running sum."""
    return f"coalesce(sum({column}) over ({over} rows between unbounded preceding and 1 preceding), 0)::BIGINT"


def case(key: str, values: dict, default: str = "NULL") -> str:
    return "case " + " ".join(f"when {key} = '{k}' then {v}" for k, v in values.items()) + f" else {default} end"


def ids_text(syms: str) -> str:
    return f"regexp_replace({syms}, '<0*([0-9]+)>', '\\1,', 'g')"


def base_syms(piece: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(hex(encode({piece})), '..'), "
        "lambda x: '<' || lpad(((('0x' || x)::INT) + 4)::VARCHAR, 5, '0') || '>'), '')"
    )


# -- corpus ---------------------------------------------------------------

cte("scored", "select d.doc_id, d.source as member, d.text, l.quality::DOUBLE as score "
              "from documents d left join labels l using (doc_id)")


def _members(mix: Mix) -> str:
    return "case " + " ".join(
        "when member in (" + ", ".join(f"'{m}'" for m in s.members) + f") then '{s.name}'" for s in mix.sources
    ) + " end"


def _shares(mix: Mix) -> dict[str, str]:
    return {k: f"{v!r}::DOUBLE" for k, v in mix.shares.items()}


def mix_ctes(tag: str, mix: Mix, tokens: str, needs: tuple[str, ...], per_batch: int, need: str) -> None:
    """The token-deficit mix over ``tokens(source, doc_id, n_tok)``, named ``mix_<tag>``.

    ``need`` is SQL over ``total``, the tokens of all passing documents.
    """
    share = case("source", _shares(mix))
    order = case("source", mix.order)
    cte(f"ranked_{tag}", f"select source, doc_id, n_tok, {before('n_tok', 'partition by source order by doc_id')} "
        f"as before, row_number() over (partition by source order by doc_id) - 1 as place from {tokens}", *needs,
        materialized=True)
    cte(f"totals_{tag}", f"select source, count(*) as n, sum(n_tok)::BIGINT as t from ranked_{tag} group by source",
        f"ranked_{tag}")
    cte(f"need_{tag}", f"select total, {need} as need from (select sum(t)::BIGINT as total from totals_{tag})",
        f"totals_{tag}")
    cte(f"epochs_{tag}", f"select source, n, t, floor((select need from need_{tag}) * {share} / t)::BIGINT + "
        f"ceil({per_batch} / n)::BIGINT + 1 as epochs from totals_{tag}", f"totals_{tag}", f"need_{tag}")
    cte(f"uses_{tag}", f"select r.source, e.epoch, r.doc_id, r.n_tok, (e.epoch * t.n + r.place) // {per_batch} as "
        f"batch_no, e.epoch * t.t + r.before as before from ranked_{tag} r join epochs_{tag} t using (source), "
        f"(select source as es, unnest(generate_series(0, epochs - 1)) as epoch from epochs_{tag}) e where e.es = r.source",
        f"ranked_{tag}", f"epochs_{tag}", materialized=True)
    cte(f"batches_{tag}", f"select source, batch_no, min(before) as batch_before, sum(n_tok)::BIGINT as batch_tok, "
        f"min(before) / {share} as ratio, {order} as ord from uses_{tag} group by source, batch_no", f"uses_{tag}")
    cte(f"ordered_{tag}", f"select *, {before('batch_tok', 'order by ratio, ord, batch_no')} as batch_start "
        f"from batches_{tag} where ratio < (select need from need_{tag})", f"batches_{tag}", f"need_{tag}")
    cte(f"mix_{tag}", f"select u.source, u.epoch, u.doc_id, u.n_tok, u.batch_no, "
        f"o.batch_start + u.before - o.batch_before as start from uses_{tag} u join ordered_{tag} o "
        f"using (source, batch_no) where o.batch_start < (select need from need_{tag})",
        f"uses_{tag}", f"ordered_{tag}", materialized=True)


def carve_ctes(tag: str, split: str, val: int, limit: str) -> None:
    """Pieces of ``mix_<tag>`` cut at shard borders, named ``carved_<tag>``."""
    cell = f"(case when {{p}} < {val} then -1 else ({{p}} - {val}) // {SHARD} end)"
    lo, hi = cell.format(p="start"), cell.format(p="(stop - 1)")
    cte(f"cells_{tag}", f"select *, unnest(generate_series({lo}, {hi})) as cell from "
        f"(select *, least(start + n_tok, {limit}) as stop from mix_{tag}, need_{tag}) where start < stop",
        f"mix_{tag}", f"need_{tag}")
    cte(f"carved_{tag}", f"select source, epoch, doc_id, start, case when cell < 0 then 'val' else '{split}' end as split, "
        "greatest(cell, 0)::INT as shard_idx, greatest(start, b) - b as shard_pos, "
        "(greatest(start, b) - start)::INT as skip, (least(stop, e) - greatest(start, b))::INT as n_tok from "
        f"(select *, case when cell < 0 then 0 else {val} + cell * {SHARD} end as b, "
        f"case when cell < 0 then {val} else {val} + (cell + 1) * {SHARD} end as e from cells_{tag})",
        f"cells_{tag}", materialized=True)


MIXES = table_mixes(SHARD, VAL)
for _tag, _mix in MIXES.items():
    _min = case("source", {s.name: "NULL" if s.min_score is None else f"{s.min_score}::DOUBLE" for s in _mix.sources})
    cte(f"passing_{_tag}", "select source, doc_id, text, score from (select *, "
        f"{_min} as min_score from (select doc_id, text, score, {_members(_mix)} as source from scored)) "
        "where source is not null and (min_score is null or coalesce(score, min_score) >= min_score) "
        "and length(text) > 50", "scored")
cte("chars_train", "select source, doc_id, (length(text) + 1)::BIGINT as n_tok from passing_train", "passing_train")

_need = {t: f"({m.val_tokens} + ceil(total / {SHARD})::BIGINT * {SHARD})" for t, m in MIXES.items()}
mix_ctes("chars", MIXES["train"], "chars_train", ("chars_train",), 128, _need["train"])
carve_ctes("chars", "train", VAL, "need")

# -- vocabulary -----------------------------------------------------------

_share = _shares(tokenizer_mix())
cte("byte_docs", "select 'text' as source, 0 as ord, doc_id, text, strlen(text)::BIGINT as n_bytes from documents "
                 "union all select 'code', 1, page_id, html, strlen(html) from pages")
cte("byte_ranked", f"select *, {before('n_bytes', 'partition by source order by doc_id')} as before, "
    f"{case('source', _share)} as share from byte_docs", "byte_docs")
cte("byte_budget", "select floor(min(t / share))::BIGINT as budget from "
    "(select source, share, sum(n_bytes)::BIGINT as t from byte_ranked group by source, share)", "byte_ranked")
cte("byte_mix", "select * from (select source, doc_id, text, n_bytes, "
    f"{before('n_bytes', 'order by before / share, ord, before, doc_id')} as start from byte_ranked "
    "where before / share < (select budget from byte_budget)) where start < (select budget from byte_budget)",
    "byte_ranked", "byte_budget", materialized=True)
cte("w0", f"select piece, count(*)::BIGINT as n, {base_syms('piece')} as syms from "
    f"(select unnest(regexp_extract_all(text, '{SPLIT}')) as piece from byte_mix) group by piece",
    "byte_mix", materialized=True)
for _i in range(MERGES):
    cte(f"p{_i}", "select l, r, '<' || l || '><' || r || '>' as pair from (select unnest(t[1:-2]) as l, unnest(t[2:]) as r, n "
        f"from (select regexp_extract_all(syms, '<([0-9]+)>', 1) as t, n from w{_i})) group by l, r having sum(n) >= 2 "
        "order by sum(n) desc, l, r limit 1", f"w{_i}", materialized=True)
    cte(f"w{_i + 1}", f"select piece, n, replace(syms, (select pair from p{_i}), '<{FIRST_MERGE + _i:05d}>') as syms "
        f"from w{_i}", f"w{_i}", f"p{_i}", materialized=True)
cte("merges", " union all ".join(
    f"select {i} as rank, l::INT as l, r::INT as r, {FIRST_MERGE + i} as new_id from p{i}" for i in range(MERGES)),
    *[f"p{i}" for i in range(MERGES)], materialized=True)
cte("v0", "select i as id, case when i < 4 then hex(encode([" + ", ".join(f"'{t}'" for t in SPECIAL_TOKENS) + "][i + 1])) "
    "else printf('%02X', i - 4) end as token_hex from (select unnest(generate_series(0, 259))::INT as i)", materialized=True)
for _i in range(MERGES):
    cte(f"v{_i + 1}", f"select id, token_hex from v{_i} union all select {FIRST_MERGE + _i}, a.token_hex || b.token_hex from p{_i} "
        f"join v{_i} a on a.id = l::INT join v{_i} b on b.id = r::INT", f"v{_i}", f"p{_i}", materialized=True)


def encoded(name: str, pieces: str, *needs: str) -> None:
    """``<name>(piece, syms)``: every piece of ``pieces`` with its tokens."""
    step = base_syms("piece")
    cte(f"{name}_0", f"select piece, {step} as syms from ({pieces})", *needs, materialized=True)
    prev = f"{name}_0"
    for i in range(MERGES):
        cur = name if i == MERGES - 1 else f"{name}_{i + 1}"
        cte(cur, f"select piece, replace(syms, (select pair from p{i}), '<{FIRST_MERGE + i:05d}>') as syms from {prev}",
            prev, f"p{i}", materialized=i % 12 == 11)
        prev = cur


cte("doc_pieces", f"select doc_id, generate_subscripts(t, 1) as pos, unnest(t) as piece from "
    f"(select doc_id, regexp_extract_all(text, '{SPLIT}') as t from documents)", materialized=True)
encoded("doc_words", "select distinct piece from doc_pieces", "doc_pieces")
cte("doc_tokens", "select doc_id, string_agg(syms, '' order by pos) || '<00000>' as syms from doc_pieces "
    "join doc_words using (piece) group by doc_id", "doc_pieces", "doc_words", materialized=True)
for _tag in MIXES:
    cte(f"tokens_{_tag}", f"select source, doc_id, (length(syms) // 7)::BIGINT as n_tok from passing_{_tag} "
        "join doc_tokens using (doc_id)", f"passing_{_tag}", "doc_tokens")
    mix_ctes(_tag, MIXES[_tag], f"tokens_{_tag}", (f"tokens_{_tag}",), PER_BATCH, _need[_tag])
    carve_ctes(_tag, _tag, MIXES[_tag].val_tokens, "need")
    cte(f"chunks_{_tag}", "select split, shard_idx, shard_pos, n_tok, substr(syms, skip * 7 + 1, n_tok * 7) as syms "
        f"from carved_{_tag} c join doc_tokens using (doc_id)", f"carved_{_tag}", "doc_tokens", materialized=True)
    cte(f"batches_of_{_tag}", f"select *, {before('n_batches', 'partition by split order by shard_idx')} as first_batch from "
        f"(select split, shard_idx, (sum(n_tok)::BIGINT - 1) // {BATCH_SEQS * SEQ_LEN} as n_batches from carved_{_tag} "
        "group by split, shard_idx)", f"carved_{_tag}", materialized=True)
cte("seq_parts", "select split, shard_idx, seq, greatest(shard_pos, seq * {t}) as spot, substr(syms, "
    "(greatest(shard_pos, seq * {t}) - shard_pos) * 7 + 1, (least(shard_pos + n_tok, seq * {t} + {t} + 1) - "
    "greatest(shard_pos, seq * {t})) * 7) as syms from (select *, unnest(generate_series(greatest(shard_pos - 1, 0) // {t}, "
    "(shard_pos + n_tok - 1) // {t})) as seq from chunks_train)".format(t=SEQ_LEN), "chunks_train")
cte("windows", "select split, shard_idx, first_batch + seq // {b} as batch_id, seq // {b} as in_shard, (seq % {b})::INT as row, "
    "syms from (select split, shard_idx, seq, string_agg(syms, '' order by spot) as syms from seq_parts group by split, shard_idx, seq) "
    "join batches_of_train using (split, shard_idx) where seq // {b} < n_batches".format(b=BATCH_SEQS),
    "seq_parts", "batches_of_train", materialized=True)

# -- conversations ----------------------------------------------------------

CHAT_LEN, MAX_PAIR = 2048, 1024
cte("turn_pieces", "select conv_id, turn, part, generate_subscripts(t, 1) as pos, unnest(t) as piece from "
    f"(select conv_id, turn, 0 as part, regexp_extract_all(role || chr(10), '{SPLIT}') as t from conversations union all "
    f"select conv_id, turn, 1, regexp_extract_all(text, '{SPLIT}') from conversations)", materialized=True)
encoded("turn_words", "select piece from turn_pieces union select chr(10)", "turn_pieces")
cte("turn_text", "select conv_id, turn, coalesce(string_agg(syms, '' order by pos) filter (where part = 0), '') as head, "
    "coalesce(string_agg(syms, '' order by pos) filter (where part = 1), '') as body "
    "from turn_pieces join turn_words using (piece) group by conv_id, turn", "turn_pieces", "turn_words")
cte("turn_tokens", "select conv_id, turn, role, '<00001>' || coalesce(head, '') || coalesce(body, '') || '<00002>' || nl as syms, "
    "repeat('0,', 1 + length(coalesce(head, ''))::INT // 7) || repeat(case when role = 'assistant' then '1,' else '0,' end, "
    "1 + length(coalesce(body, ''))::INT // 7) || repeat('0,', length(nl)::INT // 7) as mask "
    "from conversations left join turn_text using (conv_id, turn), "
    "(select syms as nl from turn_words where piece = chr(10))", "turn_text", "turn_words", materialized=True)
cte("chat_all", "select conv_id, string_agg(syms, '' order by turn) as syms, string_agg(mask, '' order by turn) as mask "
    "from turn_tokens group by conv_id", "turn_tokens", materialized=True)
cte("chats", f"select conv_id, substr(syms, 1, {(CHAT_LEN + 1) * 7}) as syms, substr(mask, 1, {(CHAT_LEN + 1) * 2}) as mask, "
    "row_number() over (order by md5('1:' || conv_id), conv_id) - 1 as place from chat_all", "chat_all", materialized=True)
cte("packed_at", "with recursive walk(place, row_id, fill) as (select place, 0::BIGINT, (length(syms) // 7)::BIGINT from chats "
    "where place = 0 union all select c.place, w.row_id + (case when w.fill + length(c.syms) // 7 > {w} then 1 else 0 end), "
    "case when w.fill + length(c.syms) // 7 > {w} then length(c.syms) // 7 else w.fill + length(c.syms) // 7 end "
    "from walk w join chats c on c.place = w.place + 1) select place, row_id from walk".format(w=CHAT_LEN + 1),
    "chats", materialized=True)
cte("packed", "select row_id, count(*)::INT as items, (sum(length(syms)) // 7)::INT as used, "
    "string_agg(syms, '' order by place) as syms, string_agg(mask, '' order by place) as mask "
    "from packed_at join chats using (place) group by row_id", "packed_at", "chats", materialized=True)

cte("turn_offsets", "select conv_id, turn, role, syms, mask, length(syms) // 7 as n_tok, "
    "coalesce(sum(length(syms) // 7) over (partition by conv_id order by turn rows between unbounded preceding and "
    "1 preceding), 0)::BIGINT as at from turn_tokens", "turn_tokens", materialized=True)
cte("replies", "select conv_id, reply_turn, row_number() over (order by conv_id) - 1 as nr, count(*) over () as n from "
    "(select conv_id, min(turn) as reply_turn from conversations where role = 'assistant' group by conv_id)")
cte("pairs", "select a.conv_id, b.conv_id as other_id, a.reply_turn, b.reply_turn as other_turn, "
    "(x.at + x.n_tok)::BIGINT as chosen_len, (x.at + y.n_tok)::BIGINT as rejected_len from replies a "
    "join replies b on b.nr = (a.nr + 1) % a.n join turn_offsets x on x.conv_id = a.conv_id and x.turn = a.reply_turn "
    "join turn_offsets y on y.conv_id = b.conv_id and y.turn = b.reply_turn", "replies", "turn_offsets", materialized=True)
cte("kept_pairs", f"select *, row_number() over (order by md5('0:' || conv_id), conv_id) - 1 as place from pairs "
    f"where chosen_len <= {MAX_PAIR} and rejected_len <= {MAX_PAIR}", "pairs", materialized=True)
cte("planned_pairs", "select *, place // 8 as step, ((place % 8) // 2)::INT as micro from kept_pairs "
    "where place // 8 < (select count(*) // 8 from kept_pairs)", "kept_pairs", materialized=True)
