"""Fixed schemas of the long tables: missing values are NULL, never NaN."""

from __future__ import annotations

FIELD = "var string, time timestamp_ntz, level int, lat double, lon double, value double"
INDEX = "name string, time timestamp_ntz, value double"
PANEL = "t int, time timestamp_ntz, var string, value double, masked boolean"
EDGE_RUNS = "cause string, effect string, lag int, alpha double, run_idx int, causal_effect double, p_value double"
EDGES = "cause string, effect string, lag int, effect_size double, p_value double"
EDGE_CSV = "Cause string, Effect string, Lag string, Causal_Effect double, p_value double"
DOMAINS = "name string, lat_min double, lat_max double, lon_min double, lon_max double"
VARIABLES = "var string, season string, months array<int>, grp string"
SKILL = "Target string, PredictorSet string, MaxLagSeason string, RMSE_Overall double, Correlation_Overall double, P_value_Overall double, HitRate_Overall double, MissRate_Overall double, N_Events_Observed int, Event_Threshold double, N_CV_Splits int, Num_Parents_Used int, Parents_Used string"
