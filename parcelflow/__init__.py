"""parcelflow: where the heat and moisture of arriving air parcels were picked up, as Spark jobs."""
