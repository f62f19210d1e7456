"""Queries that edit notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import edits as ops
from kgspark.plans.base import NOTES, raw
from kgspark.plans.registry import query


def _edit(name: str, column, sql: str | None) -> None:
    query(name, f"WITH {NOTES} SELECT path, {sql} AS raw FROM notes" if sql else None)(lambda spark, d: raw(spark, d).select("path", column().alias("raw")))


_FRONT_END = "regexp_extract(raw, '(?s)^---\\n.*?\\n---\\n')"
_edit("link_rewrite", lambda: ops.rewrite_links("raw", "NATION_3", "NATION_THREE"), r"regexp_replace(raw, '(?i)\[\[NATION_3(?:\.md)?(#[^\]|]*)?(\|[^\]]*)?\]\]', '[[NATION_THREE\1\2]]', 'g')")
_edit("rename_literal", lambda: ops.rename_literal("raw", "NATION_3", "NATION_THREE"), "replace(replace(raw, '[[NATION_3]]', '[[NATION_THREE]]'), '[[NATION_3|', '[[NATION_THREE|')")
_edit("file_append", lambda: ops.append("raw", "The end."), "raw || chr(10) || 'The end.'")
_edit("file_prepend", lambda: ops.prepend("raw", "First."), f"{_FRONT_END} || 'First.' || chr(10) || substr(raw, length({_FRONT_END}) + 1)")
_edit("search_replace", lambda: ops.replace_text("raw", "Missing", "Lost"), "replace(raw, 'Missing', 'Lost')")
_edit("search_replace_first", lambda: ops.replace_text("raw", "Missing", "Lost", every=False), "CASE WHEN instr(raw, 'Missing') > 0 THEN substr(raw, 1, instr(raw, 'Missing') - 1) || 'Lost' || substr(raw, instr(raw, 'Missing') + 7) ELSE raw END")
_edit("task_toggle", lambda: ops.toggle_task("raw", 10), "replace(replace(raw, '- [ ] call', '- [x] call'), '- [ ] review', '- [x] review')")
_edit("section_append", lambda: ops.section_column("raw", "## Overview", "Added.", "append"), "CASE WHEN contains(raw, '## Overview') THEN replace(raw, '#area' || chr(10) || '## Notes', '#area' || chr(10) || chr(10) || 'Added.' || chr(10) || chr(10) || '## Notes') ELSE raw END")
_edit("section_prepend", lambda: ops.section_column("raw", "overview", "Added.", "prepend"), "replace(raw, '## Overview' || chr(10), '## Overview' || chr(10) || 'Added.' || chr(10) || chr(10))")
_edit("section_replace", lambda: ops.section_column("raw", "Notes", "New.", "replace"), "regexp_replace(raw, '(?s)## Notes\\n.*$', '## Notes' || chr(10) || 'New.' || chr(10))")
_edit("property_set", lambda: ops.front_column("raw", {"reviewed": "yes please"}), "substr(raw, 1, 4) || regexp_replace(regexp_extract(raw, '(?s)^---\\n(.*?)\\n---\\n', 1), ' \\[(.*?), (.*?)\\]', chr(10) || '- \\1' || chr(10) || '- \\2') || chr(10) || 'reviewed: yes please' || chr(10) || '---' || chr(10) || substr(raw, length(" + _FRONT_END + ") + 1)")
_edit("property_remove", lambda: ops.front_column("raw", {}, ("type", "segment", "tags", "aliases")), "regexp_replace(regexp_replace(raw, '^---\\ntype: [^\\n]*\\n', '---' || chr(10)), '\\n(segment|tags|aliases): [^\\n]*', '', 'g')")


@query("move_note", f"WITH {NOTES} SELECT CASE WHEN path = 'nations/NATION_3.md' THEN 'nations/NATION_THREE.md' ELSE path END AS path, regexp_replace(raw, '(?i)\\[\\[NATION_3(?:\\.md)?(#[^\\]|]*)?(\\|[^\\]]*)?\\]\\]', '[[NATION_THREE\\1\\2]]', 'g') AS raw FROM notes")
def move_note(spark, d):
    return ops.move(raw(spark, d), "nations/NATION_3.md", "nations/NATION_THREE.md").select("path", "raw")


@query("create_and_delete", f"WITH {NOTES} SELECT path, length(raw) AS n FROM notes WHERE path <> 'regions/ASIA.md' UNION ALL SELECT 'inbox/new.md', 5")
def create_and_delete(spark, d):
    notes = ops.create(raw(spark, d).select("vault", "path", "raw"), "inbox/new.md", "# New", "main")
    return ops.delete(notes, "regions/ASIA.md").select("path", F.length("raw").cast("long").alias("n"))
