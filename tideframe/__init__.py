"""tideframe: panels of grouped time series, text and credit signals as Spark DataFrame operators."""
