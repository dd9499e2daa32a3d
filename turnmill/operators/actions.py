"""Whether evidence names an action's owner and its due date.

Texts must be folded beforehand (:func:`turnmill.functions.text.fold`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions import lexicon as lx
from turnmill.functions import text as tx


def holds(text: Column, field: Column) -> Column:
    """whether a text contains a field, both made comparable; never for a blank field."""
    f = tx.folded_comparable(field)
    return (f != "") & F.contains(tx.folded_comparable(text), f)


def _owner(text: Column, who: Column) -> Column:
    """F12 of folded texts."""
    key = tx.folded_comparable(who)
    named = F.try_element_at(F.filter(tx.clauses(text), lambda c: F.contains(tx.folded_comparable(c), key)), F.lit(1))
    name = tx.regex_escape(who)
    # Fixed value: how a person is charged with something.
    pattern = F.concat(
        F.lit("(?i)(?:由|让|请|安排|指定)[\\s]*"), name, F.lit("(?:来|去)?|"), name, F.lit("[\\s]*(?:负责|完成|跟进|处理|交付|执行|推进|承担)|(?<![A-Za-z0-9_])"), name,
        F.lit("[\\s]+(?:will|must|shall|owns?|is[\\s]+responsible|to[\\s]+(?:complete|deliver|ship|publish|launch))(?![A-Za-z0-9_])"),
    )
    return F.coalesce((key != "") & F.contains(tx.folded_comparable(text), key) & ~lx.uncertain_action(named) & F.regexp_like(named, pattern), F.lit(False))


def owner_supported(evidence: Column, owner: Column) -> Column:
    """the first clause that names the owner commits to something in their name."""
    return _owner(evidence, tx.js_trim(owner))


def stands_alone(clause: Column, due: Column) -> Column:
    """nothing but words of time stand beside the due date."""
    rest = F.lower(tx.no_space(F.regexp_replace(clause, F.concat(F.lit("(?i)"), tx.regex_escape(due)), F.lit(""))))
    # Fixed value: words of time.
    return rest.rlike("^(?:截止(?:到)?|到|前|之前|以前|以内|为止|by|before|due)?$")


def due_supported(evidence: Column, due: Column, task: Column, owner: Column) -> Column:
    """one clause alone is the action's, and the due date stands in it, or by itself beside it."""
    when, who = tx.js_trim(due), tx.js_trim(owner)
    key, job = tx.folded_comparable(when), tx.folded_comparable(task)
    cs = tx.clauses(evidence)
    at = F.array_position(F.transform(cs, lambda c: F.contains(tx.folded_comparable(c), key)), True)
    acts = F.transform(
        cs, lambda c: lx.concrete_action(c) & ~lx.uncertain_action(c) & (((F.char_length(job) >= 2) & F.contains(tx.folded_comparable(c), job)) | ((who != "") & _owner(c, who)))
    )
    one = F.size(F.filter(acts, lambda x: x)) == 1
    act = F.array_position(acts, True)
    near = (F.abs(act - at) == 1) & stands_alone(F.try_element_at(cs, at.cast("int")), when)
    return F.coalesce((when != "") & lx.plausible_due(when) & (at > 0) & one & ((act == at) | near), F.lit(False))
