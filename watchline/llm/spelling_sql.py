"""DuckDB SQL for the rows of ``spelling.variants`` over ``documents``."""

#: crc32 of a text's UTF-8 bytes, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

SQL = f"""WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_CRC.format("(doc_id || ':' || run)")} AS h FROM runs),
vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS shorter, left(word, i - 1) || '*' || substr(word, i + 1) AS open
  FROM vocabulary, unnest(range(1, length(word) + 1)) t(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (open) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocabulary b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocabulary b ON a.shorter = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM pairs),
found AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON v.word = r.word AND k = 1),
chains AS (SELECT word, word AS root, 0 AS steps FROM found UNION ALL SELECT c.word, f.form, steps + 1 FROM chains c JOIN found f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM found f JOIN (SELECT word, arg_max(root, steps) AS root FROM chains GROUP BY word) USING (word)"""
