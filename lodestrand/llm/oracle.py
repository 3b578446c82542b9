"""Plain SQL for the queries that SQL can express on whole tables."""

#: Characters that ``str.strip`` takes for white space.
_SPACE = "'' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(32) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"

SQL = {
    "p1_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE text IS NOT NULL AND length(trim(text, {_SPACE})) > 420",
}
