"""Lists of product groups in long form."""

from pyspark.sql import functions as F

from itemloom.operators.groups import LIST_COLUMNS, code_rows, grouped, list_rows, list_segments, whole_lists

EVIDENCE = "cnpj string, descricao_normalizada string, codigo_item string, kind string, value string, freq long, ultima timestamp_ntz, score int, first_seen decimal(20,0)"


def codes_of(spark, n):
    """One group of n codes, and one of a single code."""
    rows = spark.range(n).selectExpr("'1' as cnpj", "'GRANDE' as descricao_normalizada", "cast(id as string) as codigo")
    rows = rows.unionByName(spark.sql("select '1' as cnpj, 'UM' as descricao_normalizada, 'x' as codigo"))
    return rows.selectExpr("*", "1L as freq", "0 as score", "cast(null as timestamp_ntz) as ultima", "1L as qtd_descricoes_diferentes", "cast(null as string) as codigo_desagregado")


def test_a_list_of_very_many_values(spark):
    codes = codes_of(spark, 300_000)
    evidence = spark.createDataFrame([("1", "UM", "x", "ncm", "2", 1, None, 0, None), ("1", "UM", "x", "ncm", "1", 1, None, 0, None)], EVIDENCE)
    index = spark.createDataFrame([("1", "UM", 1)], "cnpj string, descricao_normalizada string, chave_produto long")
    rows = list_rows(evidence, codes, index)
    assert rows.count() == 600_000 + 2 + 2 + 1
    segments = list_segments(rows, 1000)
    # Ranges of values, not groups, make the tasks: no task has more than its share.
    shares = segments.groupBy(F.spark_partition_id()).agg(F.sum(F.size("valores")).alias("n")).collect()
    assert segments.agg(F.max(F.size("valores"))).first()[0] == 1000 and len(shares) > 1
    big = segments.where("descricao_normalizada = 'GRANDE' and lista = 'lista_codigos'").orderBy("segmento").collect()
    assert [r["segmento"] for r in big] == list(range(300)) and all(r["qtd_valores"] == 300_000 for r in big)
    assert [v for r in big for v in r["valores"]] == sorted(f"[{i}; 1]" for i in range(300_000))
    whole = {(r["descricao_normalizada"], r["lista"]): r["valores"] for r in whole_lists(segments).where("descricao_normalizada = 'UM'").collect()}
    table = grouped(evidence, codes, index).where("descricao_normalizada = 'UM'").first()
    for column in LIST_COLUMNS.values():
        assert list(table[column]) == whole.get(("UM", column), [])
    assert table["lista_ncm"] == ["1", "2"] and table["conflito_co_sefin"] is False


def test_nothing(spark):
    empty = codes_of(spark, 1).where("false")
    assert code_rows(empty).count() == 0
    evidence = spark.createDataFrame([], EVIDENCE)
    index = spark.createDataFrame([], "cnpj string, descricao_normalizada string, chave_produto long")
    assert list_segments(list_rows(evidence, empty, index)).count() == 0
