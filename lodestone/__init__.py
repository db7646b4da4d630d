"""lodestone: corpus analytics and hybrid retrieval as Spark DataFrame programs."""
