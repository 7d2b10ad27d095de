"""Fee forecasting under one name: series (data, ordering, storage, gate), forests over feature cells, seasonal models from Gram matrices."""

from blockloom.operators.forests import (  # noqa: F401
    FOREST_LOOKBACKS, FOREST_SETTINGS, FOREST_SPACE, Forest, drawn_settings, evaluate, feature_cells, fold_cells, forecast_forests, found_settings,
    predict_forests, score_forests, search_forest, train_forests)
from blockloom.operators.seasonal import (  # noqa: F401
    SEASONAL_GRID, SEASONAL_GRID_SHORT, SEASONAL_LOOKBACKS, STRAIGHT, Seasonal, cutoffs, data_sufficiency, forecast_seasonal, grid_points, min_points,
    rolling_cv, search_lookbacks, search_seasonal, train_seasonal)
from blockloom.operators.series import (  # noqa: F401
    DAY, FEES, HORIZON_HOURS, HOUR, TIME_FEATURES, chrono_split, clean_targets, horizon, lookback, naive_mse, naive_rolling_cv, needs_retrain,
    newest_first, order_fees, prediction_rows, prediction_view, time_features)
