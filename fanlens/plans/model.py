"""AudienceModel: every derived relation of one interaction log, built lazily.

Relations are plain DataFrames.  The three pre-aggregations that many
operators share (``pair_days``, ``pairs``) and the label tables are persisted
(MEMORY_AND_DISK, recomputed from lineage if an executor is lost) the first
time they are used, so a dashboard session that runs many operators scans and
shuffles the raw log once for each.  A relation that needs neither days nor users is
summed from the log itself unless ``pair_days`` is there already.
"""

from __future__ import annotations

import threading
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanlens.operators import activity, base, churn, cohort, flows, funnel, growth, labels, rfm
from fanlens.params import Params
from fanlens.sources import dims
from fanlens.sources.interactions import FIXTURES


class AudienceModel:
    def __init__(
        self,
        ia: DataFrame,
        params: Params = Params(),
        dim: DataFrame | None = None,
        persist: bool = True,
        durable: bool = False,
        roll_ups: tuple[DataFrame, DataFrame] | None = None,
    ):
        """``roll_ups``: stored ``pair_days`` and ``pair_months`` of the log, which are then read
        instead of it (``fanlens.operators.maintained``).

        ``durable``: write the shared ``pair_days`` as a reliable checkpoint into the
        shared ``spark.checkpoint.dir`` (cuts the lineage to the raw log, so a lost
        executor never re-scans the log); recommended on clusters."""
        self._durable = durable
        self._roll_ups = roll_ups
        self._persist = persist or durable
        self._held: list[DataFrame] = []
        self.ia = ia  # never held: the shared relation is pair_days
        self.p = params
        self.dim = self._keep(dim) if dim is not None else None  # read by every selection

    # -- helpers ---------------------------------------------------------------
    def _keep(self, df: DataFrame) -> DataFrame:
        if self._persist:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._held.append(df)
        return df

    def release(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()

    @property
    def spark(self) -> SparkSession:
        return self.ia.sparkSession

    # -- shared pre-aggregations ----------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        return base.with_month(self.ia, self.p.grain)

    @cached_property
    def pair_days(self) -> DataFrame:
        if self._roll_ups:
            return self._keep(base.by_uid(self._roll_ups[0].drop("month")))
        if self._durable:
            from fanlens.session import ensure_checkpoint_dir

            # reliable checkpoint of the aggregate in the shared folder, then the usual
            # user partitioning: a lost executor recomputes from here, not from the log
            ensure_checkpoint_dir(self.ia.sparkSession)
            agg = base.pair_days(self.ia, by_user=False).checkpoint(eager=True)
            return self._keep(base.by_uid(agg))
        return self._keep(base.pair_days(self.ia))

    def _at_hand(self, relation: str) -> bool:
        """Whether ``relation`` is built already (days also: stored or durable), so it is read instead of the log."""
        return relation in self.__dict__ or relation == "pair_days" and bool(self._roll_ups or self._durable)

    @cached_property
    def pair_months(self) -> DataFrame:
        if self._roll_ups and self.p.grain == "month":
            return self._keep(base.by_uid(self._roll_ups[1]))
        if not self._at_hand("pair_days"):  # else the days of all pairs would be shuffled and held for this alone
            return self._keep(base.log_months(self.ia, self.p.grain))
        return self._keep(base.pair_months(self.pair_days, self.p.grain))

    @cached_property
    def pairs(self) -> DataFrame:
        return self._keep(base.pairs(self.pair_months))

    @cached_property
    def ref_ts_value(self) -> str | None:
        """Latest event time, fetched once as a scalar so filters on it reach the scan."""
        if self._roll_ups:
            latest = self._roll_ups[1]
        elif self._at_hand("pairs"):
            latest = self.pairs
        else:
            latest = self.pair_days if self._at_hand("pair_days") else self.ia.select(F.col("ts").alias("last_ts"))
        row = latest.agg(F.max("last_ts").cast("string").alias("m")).first()
        return row["m"] if row else None

    @property
    def ref_ts(self) -> Column:
        return F.lit(self.ref_ts_value).cast("timestamp_ntz")

    # -- labels ------------------------------------------------------------------
    @cached_property
    def first_touch(self) -> DataFrame:
        return labels.first_touch(self.pairs)

    @cached_property
    def pair_stats(self) -> DataFrame:
        return labels.pair_stats(self.pairs, self.ref_ts)

    @cached_property
    def entity_threshold(self) -> DataFrame:
        return self._keep(labels.entity_threshold(self.pair_stats, self.p))

    @cached_property
    def pair_label(self) -> DataFrame:
        return self._keep(labels.pair_label(self.pair_stats, self.entity_threshold))

    @cached_property
    def user_global_label(self) -> DataFrame:
        return labels.user_global_label(self.pair_label)

    @cached_property
    def pair_label_augmented(self) -> DataFrame:
        return labels.pair_label_augmented(self.pair_label, self.user_global_label, self.p)

    @cached_property
    def user_modal_label(self) -> DataFrame:
        return self._keep(labels.user_modal_label_from_pairs(self.pair_label))

    # -- flows -----------------------------------------------------------------
    @cached_property
    def flow_source(self) -> DataFrame:
        return self._keep(flows.flow_source(self.first_touch, self.pair_months, self.p))

    @cached_property
    def flow_target(self) -> DataFrame:
        return self._keep(flows.flow_target(self.first_touch, self.pair_months, self.p))

    @cached_property
    def flow_matrix_in(self) -> DataFrame:
        return self._keep(flows.flow_matrix_in(self.flow_source))

    @cached_property
    def flow_matrix_out(self) -> DataFrame:
        return self._keep(flows.flow_matrix_out(self.flow_target))

    # -- funnel ----------------------------------------------------------------
    @cached_property
    def funnel_core(self) -> DataFrame:
        return self._keep(funnel.funnel_core(funnel.pair_funnel(self.pair_days, self.p)))

    @cached_property
    def acquisition(self) -> DataFrame:
        if self._roll_ups or self._at_hand("pairs"):
            return funnel.acquisition(self.first_touch)
        return funnel.acquisition(base.log_first_touch(self.ia, self.p.grain))

    @cached_property
    def referral(self) -> DataFrame:
        return funnel.referral(self.flow_source, self.p)

    @cached_property
    def aarrr_metrics(self) -> DataFrame:
        return funnel.aarrr_metrics(self.funnel_core, self.referral)

    # -- rfm -------------------------------------------------------------------
    @cached_property
    def rfm_base(self) -> DataFrame:
        # read twice (percentiles per entity, then scoring): keep the 90-day slice
        return self._keep(rfm.rfm_base(self.ia, self.ref_ts, self.p))

    @cached_property
    def rfm_thresholds(self) -> DataFrame:
        return self._keep(rfm.rfm_thresholds(self.rfm_base, self.p))

    @cached_property
    def rfm_score(self) -> DataFrame:
        return rfm.rfm_score(self.rfm_base, self.rfm_thresholds)

    @cached_property
    def rfm_user(self) -> DataFrame:
        return self._keep(rfm.rfm_user(self.rfm_score))

    @cached_property
    def rfm_daily_contribution(self) -> DataFrame:
        if self._at_hand("pair_days"):
            return rfm.rfm_daily_contribution(self.pair_days, self.rfm_user)
        scored = self.ia.join(self.rfm_user.select("uid", "entity"), ["uid", "entity"], "left_semi")  # the days of scored pairs only
        return rfm.rfm_daily_contribution(base.pair_days(scored, by_user=False), self.rfm_user)

    # -- activity --------------------------------------------------------------
    def _days(self) -> DataFrame:
        return self.pair_days if self._at_hand("pair_days") else base.event_days(self.ia)

    @cached_property
    def monthly_active(self) -> DataFrame:
        return activity.monthly_active(self.pair_months)

    @cached_property
    def active_layers(self) -> DataFrame:
        return activity.active_layers(self.monthly_active, self.user_modal_label)

    @cached_property
    def entity_active_layers(self) -> DataFrame:
        return self._keep(activity.entity_active_layers(self.monthly_active, self.user_modal_label))

    @cached_property
    def penetration(self) -> DataFrame:
        return activity.penetration(self.monthly_active)

    @cached_property
    def daily_type(self) -> DataFrame:
        return activity.daily_type(self._days(), self.p)

    @cached_property
    def entity_daily_type(self) -> DataFrame:
        return activity.entity_daily_type(self._days(), self.p)

    @cached_property
    def active_layers_totals(self) -> DataFrame:
        return activity.active_layers_totals(self.entity_active_layers)

    # -- churn -----------------------------------------------------------------
    @cached_property
    def flow_net_churn(self) -> DataFrame:
        return churn.flow_net_churn(self.flow_matrix_in, self.flow_matrix_out, self.active_layers, self.p)

    @cached_property
    def entity_flow_net_churn(self) -> DataFrame:
        return churn.entity_flow_net_churn(self.flow_matrix_in, self.flow_matrix_out, self.entity_active_layers, self.p)

    # -- cohorts ---------------------------------------------------------------
    @cached_property
    def cohort_retention(self) -> DataFrame:
        return cohort.cohort_retention(self.first_touch, self.pair_label, self.pair_months, p=self.p)

    @cached_property
    def cohort_layer_funnel(self) -> DataFrame:
        return cohort.cohort_layer_funnel(self.first_touch, self.pair_label, self.p)

    # -- growth ----------------------------------------------------------------
    @cached_property
    def growth_sequence(self) -> DataFrame:
        return growth.growth_sequence(self.entity_active_layers)

    @cached_property
    def growth_params_init(self) -> DataFrame:
        return growth.growth_params_init(self.growth_sequence, self.p)

    @cached_property
    def lifecycle_stage(self) -> DataFrame:
        return growth.lifecycle_stage(self.growth_sequence, self.growth_params_init)


_MODELS: dict[tuple, AudienceModel] = {}
_LOCK = threading.Lock()


def model_for(spark: SparkSession, sf_dir: str, fixture: str = "f1", params: Params = Params()) -> AudienceModel:
    """Memoised model per (application, data folder, fixture, params)."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"), fixture, params)
    with _LOCK:
        m = _MODELS.get(key)
        if m is None:
            ia = FIXTURES[fixture](spark, sf_dir)
            m = AudienceModel(ia, params, dim=dims.nation_entities(spark, sf_dir))
            _MODELS[key] = m
        return m


def release_all() -> None:
    with _LOCK:
        for m in _MODELS.values():
            m.release()
        _MODELS.clear()
