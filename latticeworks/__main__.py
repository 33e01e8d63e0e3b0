from .plans.interpreter import main

raise SystemExit(main())
