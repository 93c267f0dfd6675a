"""The consolidation job: from source extracts to the seven result tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import groups as g
from ..operators.items import audited_items, classify, clean_items, product_index, profiles, variants
from ..operators.sums import annual_pivot, annual_sums, year_columns
from ..sources.layouts import canonical_items
from ..sources.schemas import PRODUCT_KEYS
from ..sources.writer import CLUSTERED, save_table, stage, staged_tables


@dataclass(frozen=True)
class References:
    """Reference tables of the goods class; each may be absent."""

    cest_ncm: DataFrame | None = None
    cest: DataFrame | None = None
    ncm: DataFrame | None = None


class Consolidation:
    """The steps over one item table, each planned when first asked for.

    With ``reuse`` the steps that several results read are staged as tables, so
    that each is worked out once; without it they stay part of one plan.
    ``keep`` gives them a place of its own: it takes a name and what makes the table.
    """

    def __init__(
        self,
        items: DataFrame,
        references: References = References(),
        reuse: bool = False,
        keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None,
    ):
        self.items = items
        self.references = references
        self._place = keep
        self._keep = keep or (lambda name, make: stage(make(), name) if reuse else make())

    @cached_property
    def profiles(self) -> DataFrame:
        return self._keep("profiles", lambda: profiles(self.items))

    @cached_property
    def variants(self) -> DataFrame:
        r = self.references
        tables = (r.cest_ncm, r.cest, r.ncm)
        if all(t is None for t in tables):
            return self._keep("variants", lambda: classify(clean_items(variants(self.items))))
        # What classification reads twice is kept; its result is not written once more.
        cleaned = clean_items(variants(self.items)).drop("codigo_num_sort")
        return classify(cleaned, *tables, keep=self._place)

    @cached_property
    def index(self) -> DataFrame:
        # Numbered rows are staged already; only a place that outlives the session takes them once more.
        return self._place("index", lambda: product_index(self.variants)) if self._place else product_index(self.variants)

    @cached_property
    def evidence(self) -> DataFrame:
        return self._keep("evidence", lambda: g.evidence(self.variants))

    @cached_property
    def codes(self) -> DataFrame:
        return self._keep("codes", lambda: g.codes(self.evidence))

    @cached_property
    def groups(self) -> DataFrame:
        return self._keep("groups", lambda: g.grouped(self.evidence, self.codes, self.index))

    @cached_property
    def sums(self) -> DataFrame:
        return self._keep("sums", lambda: annual_sums(self.profiles))

    @cached_property
    def pivot(self) -> DataFrame | None:
        columns = year_columns(self.sums)
        return annual_pivot(self.sums, columns) if columns else None

    def representative_codes(self) -> DataFrame:
        return g.representative_codes(self.codes)

    def unified_descriptions(self) -> DataFrame:
        return g.unified_descriptions(self.groups, self.pivot)

    def final_products(self) -> DataFrame:
        return g.final_products(self.groups, self.pivot)

    def split_codes(self) -> DataFrame:
        return g.split_codes(self.evidence, self.codes, self.index)

    def code_mapping(self) -> DataFrame:
        described = self._keep("described", lambda: g.described_codes(self.evidence, self.codes))
        return g.code_mapping(self.codes, described)

    def product_index(self) -> DataFrame:
        return self.index.select("cnpj", "chave_produto", *PRODUCT_KEYS, "lista_unidades")

    def audited_items(self) -> DataFrame:
        return audited_items(self.items, self.index)

    def results(self) -> dict[str, Callable[[], DataFrame]]:
        """What makes each of the seven result tables."""
        return {
            "tabela_descricoes_unificadas": self.unified_descriptions,
            "codigos_desagregados": self.split_codes,
            "tabela_produtos": self.final_products,
            "mapeamento_codigos": self.code_mapping,
            "indice_produtos": self.product_index,
            "tabela_somas_anuais": lambda: self.sums,
            "tabela_itens_auditados": self.audited_items,
        }


#: Result tables and the keys that order each inside a taxpayer.
TABLES = {
    "tabela_descricoes_unificadas": ["descrição_normalizada"],
    "codigos_desagregados": ["codigo_desagregado"],
    "tabela_produtos": ["descrição_normalizada"],
    "mapeamento_codigos": ["codigo_original", "descricao_normalizada"],
    "indice_produtos": ["chave_produto"],
    "tabela_somas_anuais": ["descricao_normalizada", "ano", "tipo_operacao"],
    "tabela_itens_auditados": ["chave_produto", "data_mov"],
}


@dataclass(frozen=True)
class Written:
    path: str
    rows: int


def run_all(
    spark: SparkSession,
    sources: Mapping[str, DataFrame | None],
    references: References,
    out: str,
    layout: str = CLUSTERED,
) -> dict[str, Written]:
    """Consolidate the given extracts and write the seven tables under ``out``.

    All seven are written, with their schemas, even when there are no items.
    Tables that were staged on the way are deleted at the end.
    """
    job = Consolidation(canonical_items(sources, spark), references, reuse=True)
    results = job.results()
    written = {}
    with staged_tables(spark):
        for name, keys in TABLES.items():
            path = f"{out}/{name}"
            written[name] = Written(path, save_table(results[name](), path, keys, layout))
    return written
