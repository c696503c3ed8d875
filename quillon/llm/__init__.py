"""Operations of a large-scale training-data pipeline.  Nothing else in quillon imports this subpackage."""
